"""The blocks of Markdown texts as a relation: kind, first and last line, depth.

Lines go through a small automaton. Only fences carry state from line to line. A text is cut
into stretches where it lies, a short fold over its lines (fence marks, items and breaks)
finds the state that each stretch starts in, and every stretch then runs from its own
starting state: a long text is spread over tasks. Runs of lines become blocks as gaps and
islands, over the numbers of structural lines only.

Rules, line by line: a fence opens at three or more backticks or tildes, whatever stands
before it as white space, and closes at as many or more of the same; inside, nothing else
counts. Headings are marked by one to six # or underlined. A quote of depth d is a run of
lines with d or more >. A list of depth d is a run of items indented by 2 * (d - 1) or more,
with nothing between them but blank and indented lines; a tab counts four. A table is a line
with a pipe, a rule line, and further lines with a pipe. Depths go to DEEPEST.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.folds import emitting, let
from paperloom.functions.text import lines_of

STRETCH, DEEPEST, LONGEST = 512, 32, 16
#: Texts of more signs are spread over tasks.
SPREAD = 1 << 16
#: Patterns of lines; SQL reads them as well, without the possessive loops.
FENCE = r"^[ \t]*+(`{3,}|~{3,})"
ATX = r"^ {0,3}(#{1,6})[ \t]++[^ \t]"
UNDER = r"^[ \t]*+(?:=++|-{3,}+)[ \t]*+$"
ITEM = r"^([ \t]*+)(?:[-+*]|[0-9]++[.)])[ \t]++[^ \t]"
QUOTE = r"^[ \t]*+>[ \t>]*+"
RULE = r"^[ \t]*+\|?+[ \t]*+:?+-{3,}+:?+[ \t]*+(?:\|[ \t]*+:?+-{3,}+:?+[ \t]*+)++\|?+[ \t]*+$"
BLANK = r"^[ \t]*+$"
#: First signs of lines that may be any of these; those with a pipe may be as well.
MARKED = "`~#=>+*-0123456789"
_STATE, _LINE = "struct<fence:int,b:bigint,k:bigint>", "struct<n:bigint,kind:string,depth:int,b:bigint,k:bigint>"
_START = "struct<start:int,b0:bigint,k0:bigint>"


def _own(mark: Column) -> Column:
    """The state that a fence mark opens; 0 for a line that is no fence."""
    return F.when(mark == "", 0).otherwise(F.least(F.length(mark), F.lit(LONGEST)) - 2 + F.when(F.startswith(mark, F.lit("~")), LONGEST - 2).otherwise(0))


def _next(state: Column, own: Column) -> Column:
    half = LONGEST - 2
    return F.when(own == 0, state).when(state == 0, own).when(((state <= half) == (own <= half)) & (own >= state), 0).otherwise(state)


def _starts(lines: Column, ats: Column, stretch: int) -> Column:
    """start (state), b0 and k0 (breaks and items so far) of each stretch of a text, from a
    fold over its lines; a text of one stretch begins outside."""
    facts = lambda x: let(F.struct(_own(F.regexp_extract(x, FENCE, 1)).alias("own"), x.rlike(ITEM).alias("item"), x.rlike(BLANK).alias("blank"), x.rlike(r"^(?: {2}|\t)").alias("deep")), lambda f: F.struct(f["own"].alias("own"), f["item"].cast("bigint").alias("k"), (~f["item"] & ~f["blank"] & ~f["deep"]).cast("bigint").alias("b")))
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).cast("bigint").alias("b0"), F.lit(0).cast("bigint").alias("k0")).cast(_START)

    def moved(state, f):
        out = (state["start"] == 0) & (f["own"] == 0)
        return F.struct(_next(state["start"], f["own"]).alias("start"), (state["b0"] + F.when(out, f["b"]).otherwise(1)).alias("b0"), (state["k0"] + F.when(out, f["k"]).otherwise(0)).alias("k0")).cast(_START)

    def scan(state, at):
        return F.struct(F.aggregate(F.transform(F.slice(lines, at + 1, F.lit(stretch)), facts), state, moved).alias("state"), F.array(state).alias("out"))

    return F.when(F.size(lines) <= stretch, F.array(zero)).otherwise(emitting(ats, zero, _START, _START, scan)["out"])


def _stretches(docs: DataFrame, text: str, stretch: int) -> DataFrame:
    """__key, kept columns, total (lines of the text), at (first line of the stretch), before
    (the line above it), lines, and what _starts() finds."""

    def cut(x):
        ats = F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(stretch))
        row = lambda at, s: F.struct(at.alias("at"), F.size(x).alias("total"), F.coalesce(F.get(x, at - 1), F.lit("")).alias("before"), F.slice(x, at + 1, F.lit(stretch)).alias("lines"), *[s[c].alias(c) for c in ("start", "b0", "k0")])
        return let(_starts(x, ats, stretch), lambda starts: F.transform(ats, lambda at, j: row(at, F.get(starts, j))))

    keyed = docs.withColumn("__key", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).withColumn("__cut", let(lines_of(F.col(f"`{text}`")), cut))
    return keyed.drop(text).select("*", F.inline_outer("__cut")).drop("__cut").filter("total > 0")


def _dealt(docs: DataFrame, text: str, stretch: int) -> DataFrame:
    """The stretches of all texts, those of long texts spread over tasks."""
    long = F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)) > SPREAD
    return _stretches(docs.filter(~long), text, stretch).unionByName(_stretches(docs.filter(long), text, stretch).repartition("__key", "at"))


def _facts(line: Column, previous: Column, *more: Column) -> Column:
    """What a marked line is. Patterns are long to fail, as they are tried at every place of a
    line, so its first sign decides which of them are tried at all."""
    bare, pipe = F.ltrim(line, F.lit(" \t")), F.contains(line, F.lit("|"))
    indent = F.length(F.replace(F.left(line, F.length(line) - F.length(bare)), F.lit("\t"), F.lit("    ")))
    under = line.rlike(UNDER) & ~previous.rlike(BLANK) & ~previous.rlike(FENCE)

    def by(sign):
        having = lambda signs, value, other=0: F.when(sign.isin(*signs), value).otherwise(other)
        return F.struct(
            *more, having("`~", _own(F.regexp_extract(line, FENCE, 1))).alias("own"), indent.alias("indent"), having("-+*0123456789", line.rlike(ITEM), False).alias("item"),
            having(">", F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))).alias("quote"), having("#", F.length(F.regexp_extract(line, ATX, 1))).alias("atx"),
            having("=-", F.when(under, F.when(F.contains(line, F.lit("=")), 1).otherwise(2)).otherwise(0)).alias("under"), pipe.alias("pipe"), (pipe & F.contains(previous, F.lit("|")) & line.rlike(RULE) & ~previous.rlike(FENCE)).alias("rule"),
        )

    return let(F.left(bare, F.lit(1)), by)


def _code(line: Column) -> Column:
    """2 for a line that may be structural, 1 for others that end a list, 0 for the rest."""
    sign, deep = F.left(F.ltrim(line, F.lit(" \t")), F.lit(1)), F.startswith(line, F.lit("  ")) | F.startswith(line, F.lit("\t")) | F.startswith(line, F.lit(" \t"))
    return F.when(sign.isin(*MARKED) | F.contains(line, F.lit("|")), 2).when((sign != "") & ~deep, 1).otherwise(0)


def _structural(rows: DataFrame) -> DataFrame:
    """One row for each structural line of each stretch (with start, the state it begins in,
    and b and k, the breaks and items before it). Only marked lines are looked at by all
    patterns and folded; each knows how many others, and how many breaks, are before it."""

    def step(state, x):
        fence, now = state["fence"], _next(state["fence"], x["own"])
        out = (fence == 0) & (x["own"] == 0)
        item, breaks = out & x["item"], ~out | (~x["item"] & (x["indent"] < 2))
        b, k = state["b"] + F.when(fence == 0, x["plain"]).otherwise(x["skipped"]) + breaks.cast("int"), state["k"] + item.cast("bigint")
        row = lambda kind, depth, when: F.when(when, F.struct(x["n"].alias("n"), F.lit(kind).alias("kind"), depth.cast("int").alias("depth"), b.alias("b"), k.alias("k")))
        found = F.array(
            row("open", F.lit(1), (fence == 0) & (x["own"] != 0)), row("close", F.lit(1), (fence != 0) & (now == 0)), row("heading", x["atx"], out & (x["atx"] > 0)), row("under", x["under"], out & (x["under"] > 0)),
            row("quote", F.least(x["quote"], F.lit(DEEPEST)), out & (x["quote"] > 0)), row("item", F.least(1 + F.floor(x["indent"] / 2), F.lit(DEEPEST)), item), row("pipe", x["rule"].cast("int"), out & x["pipe"]),
        )
        return F.struct(F.struct(now.alias("fence"), b.alias("b"), k.alias("k")).alias("state"), F.filter(found, lambda r: r.isNotNull()).alias("out"))

    def marked(codes, places):
        def one(i, j):
            begin = F.when(j == 0, 0).otherwise(F.get(places, j - 1) + 1)
            between = F.slice(codes, begin + 1, i - begin)
            own = (F.col("at") + i).cast("bigint").alias("n"), (i - begin).alias("skipped"), (i - begin - F.size(F.array_remove(between, 1))).alias("plain")
            previous = F.when(i == 0, F.col("before")).otherwise(F.get("lines", i - 1))
            return let(F.get("lines", i), lambda line: _facts(line, previous, *own))

        return F.transform(places, one)

    codes = F.transform("lines", _code)
    lines = let(codes, lambda c: let(F.filter(F.transform(c, lambda x, i: F.when(x == 2, i)), lambda i: i.isNotNull()), lambda p: marked(c, p)))
    begun = F.struct(F.col("start").alias("fence"), F.col("b0").alias("b"), F.col("k0").alias("k")).cast(_STATE)
    made = rows.withColumn("__made", emitting(lines, begun, _STATE, _LINE, step))
    return made.drop("lines", "before", "at", "start", "b0", "k0").select("*", F.inline_outer("__made.out")).drop("__made").filter("kind is not null")


def blocks(docs: DataFrame, text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """The other columns of docs with kind (fence, heading, quote, list, table), first_line and
    last_line (from 0) and depth, a row for each block. Null and empty texts have none; rows
    that are alike in all columns count once. A fence that stays open ends with the text."""
    names = ["kind", "first_line", "last_line", "depth"]
    kept = [c for c in docs.columns if c not in (text, *names)]
    lines = _structural(_dealt(docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("__text")), "__text", stretch))
    own, n, kind = [f"__k{i}" for i in range(len(kept))], F.col("n"), F.col("kind")
    group = F.when(kind.isin("open", "close"), "fence").when(kind.isin("heading", "under"), "heading").when(kind == "item", "list").when(kind == "pipe", "table").otherwise(kind)
    deep = F.when(kind.isin("quote", "item"), F.sequence(F.lit(1), F.col("depth"))).when(kind == "pipe", F.array(F.lit(1))).otherwise(F.array("depth"))
    rows = lines.withColumn("__group", group).withColumn("d", F.explode(deep))
    rank = F.dense_rank().over(Window.partitionBy("__key", "__group", "d").orderBy("n"))
    rows = rows.withColumn("__rank", rank.cast("bigint"))
    group, rank = F.col("__group"), F.col("__rank")
    island = F.when(group == "fence", F.floor((rank - 1) / 2)).when(group == "heading", n).when(group == "list", F.col("k") - rank).otherwise(n - rank)
    runs = rows.withColumn("__island", island).withColumn("__b", F.when(group == "list", F.col("b"))).groupBy("__key", "__group", "d", "__island", "__b").agg(
        *[F.first(c).alias(c) for c in own], F.first("total").alias("total"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.bool_or(kind == "under").alias("under"), F.bool_or(kind == "close").alias("closed"), F.min(F.when((kind == "pipe") & (F.col("depth") == 1), n)).alias("rule")
    )  # one shuffle: the groups lie within the partitions of the window
    rule = F.col("rule")  # one below a line with a pipe
    first = F.when(group == "table", rule - 1).when(F.col("under"), F.col("lo") - 1).otherwise(F.col("lo"))
    last = F.when((group == "fence") & ~F.col("closed"), (F.col("total") - 1).cast("bigint")).otherwise(F.col("hi"))
    found = runs.filter((group != "table") | rule.isNotNull())
    return found.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], group.alias("kind"), first.cast("bigint").alias("first_line"), last.cast("bigint").alias("last_line"), F.col("d").cast("int").alias("depth"))
