"""Counts of Markdown constructs as column expressions; a fold over fence lines finds fences.

Patterns are used with (?U) where the rules mean Unicode white space and digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.kernel import patterns as P

from .folds import emitting, let
from .text import CONTROL_CLASS, RTL_CLASS, lines_of

_FENCES = "struct<mark:string,opened:int,start:int>"
_GAP = "struct<at:int,n:int>"
_BLANK = r"(?U)^\s*$"


def _outside(lines: Column) -> Column:
    """What lies outside fences (each of them becomes an empty line), how many fences
    opened, and the mark of one that stays open. Only fence lines are folded over; the
    stretches between them are cut out of the array as they are."""
    marks = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(F.regexp_replace(x, r"(?U)^\s+", ""), P.FENCE, 1).alias("mark")))

    def step(state, line):
        mark, inside = line["mark"], state["mark"] != ""
        closes = inside & (F.left(mark, F.lit(1)) == F.left(state["mark"], F.lit(1))) & (F.length(mark) >= F.length(state["mark"]))
        gap = F.array(F.struct(state["start"].alias("at"), (line["i"] - state["start"]).alias("n")))
        now = F.struct(F.when(~inside, mark).when(closes, "").otherwise(state["mark"]).alias("mark"), (state["opened"] + (~inside).cast("int")).alias("opened"), F.when(closes, line["i"] + 1).otherwise(state["start"]).alias("start"))
        return F.struct(now.alias("state"), F.when(~inside, gap).otherwise(F.array().cast(f"array<{_GAP}>")).alias("out"))

    def finish(done):
        state = done["state"]
        last = F.when(state["mark"] == "", F.slice(lines, state["start"] + 1, F.greatest(F.size(lines) - state["start"], F.lit(0)))).otherwise(F.array().cast("array<string>"))
        parts = F.transform(done["out"], lambda g: F.concat(F.slice(lines, g["at"] + 1, g["n"]), F.array(F.lit(""))))
        return F.struct(state["mark"].alias("mark"), state["opened"].alias("opened"), F.concat(F.flatten(parts), last).alias("lines"))

    start = F.struct(F.lit("").alias("mark"), F.lit(0).alias("opened"), F.lit(0).alias("start")).cast(_FENCES)
    return let(emitting(F.filter(marks, lambda m: m["mark"] != ""), start, _FENCES, _GAP, step), finish)


def inline_math(text: Column) -> Column:
    """How many formulas between single dollar signs. Each sign is a mark that can open (o),
    close (c), do both (b) or neither, by its neighbours; an opener takes the first closer of
    its line. Marks are read off the pieces between the signs, so that the time grows with
    the text, however many signs never close."""

    def marks(pieces):
        last = F.size(pieces) - 1

        def mark(i):
            before, after = F.get(pieces, i), F.get(pieces, i + 1)
            left = F.when(before != "", F.right(before, F.lit(1))).when(i > 0, "$").otherwise("")
            right = F.when(after != "", F.left(after, F.lit(1))).when(i + 1 < last, "$").otherwise("")
            opens, closes = ~left.isin("\\", "$") & ~right.rlike(r"(?U)^[\s$\d]"), ~left.rlike(r"(?U)^[\s\\]") & (right != "$")
            return F.concat(F.when(opens & closes, "b").when(opens, "o").when(closes, "c").otherwise(""), F.when(F.contains(after, F.lit("\n")), "\n").otherwise(""))

        return F.when(last > 0, F.array_join(F.transform(F.sequence(F.lit(0), last - 1), mark), "")).otherwise("")

    found = F.regexp_extract_all(let(F.split(text, r"\$", -1), marks), F.lit("[ob]o*+[cb]?+"), F.lit(0))
    return F.size(F.filter(found, lambda x: x.rlike("^[ob]o*+[cb]$"))).cast("bigint")


def links(text: Column) -> Column:
    """How many links; images are none. What follows the last bracket of a line cannot end one."""
    text = F.regexp_replace(text, r"(?m)(?<=[)\"\n]|\A)[^)\"\n]*+$", "")
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(P.LINK), F.lit(0)), lambda x: x.rlike(P.WHOLE_LINK))).cast("bigint")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def _pairs(text: Column, mark: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / F.lit(2 * len(mark))).cast("bigint")


def with_features(docs: DataFrame, text: str = "text", source: Column | None = None) -> DataFrame:
    """docs with one column for each feature of the Markdown in `text`, named f_<feature>,
    and f_syntax_errors. A null text is empty."""
    s = F.coalesce(F.col(text), F.lit(""))
    wide = F.lower(F.trim(source if source is not None else F.lit("llm"))) != "commonmark"
    step = docs.withColumn("__s", s).withColumn("__lines", lines_of(F.col("__s"))).withColumn("__fold", _outside(F.col("__lines")))
    step = step.withColumn("__logical", F.transform("__fold.lines", lambda x: F.regexp_replace(x, "(?U)" + P.QUOTE, "")))
    step = step.withColumn("__text", F.array_join("__logical", "\n")).withColumn("__shown", F.regexp_replace("__text", P.CODE_SPAN, ""))
    zero = F.lit(0).cast("bigint")
    if_wide = lambda c: F.when(wide, c).otherwise(zero)
    pairs = F.arrays_zip(F.slice("__logical", F.lit(1), F.greatest(F.size("__logical") - 1, F.lit(0))).alias("a"), F.slice("__logical", F.lit(2), F.greatest(F.size("__logical") - 1, F.lit(0))).alias("b"))
    level = lambda p: F.when(p["a"].rlike(_BLANK), 0).when(p["b"].rlike("(?U)" + P.SETEXT[1]), 1).when(p["b"].rlike("(?U)" + P.SETEXT[2]), 2).otherwise(0)
    step = step.withColumn("__setext", F.transform(pairs, level))
    levels = F.concat(F.transform(F.regexp_extract_all("__text", F.lit("(?mU)" + P.HEADING), F.lit(1)), F.length), F.filter("__setext", lambda x: x > 0))
    rule = lambda x: x.rlike("(?U)" + P.THEMATIC_BREAK)
    rules = F.size(F.filter(F.transform("__logical", lambda x, i: rule(x) & ((i == 0) | (F.coalesce(F.get("__setext", i - 1), F.lit(0)) == 0))), lambda b: b))
    bare = F.size(F.filter("__fold.lines", lambda x: x.rlike("(?U)" + P.BARE_MATH))).cast("bigint")
    step = step.withColumn("__bare", bare).withColumn("__linemath", _count(F.col("__shown"), P.LINE_MATH)).withColumn("__levels", levels)
    half = F.floor(F.col("__bare") / 2).cast("bigint")
    inline = inline_math(F.col("__shown"))
    shown = F.col("__shown")
    found = {
        "bytes": F.octet_length("__s").cast("bigint"),
        "lines": F.size("__lines").cast("bigint"),
        "headings": F.size("__levels").cast("bigint"),
        "heading_levels": F.col("__levels"),
        "tables": if_wide(_count(F.col("__text"), "(?mU)" + P.TABLE_RULE)),
        "list_items": _count(F.col("__text"), "(?mU)" + P.LIST_ITEM),
        "fenced_code_blocks": F.col("__fold.opened").cast("bigint"),
        "math_expressions": if_wide(half + F.col("__linemath") + inline),
        "block_math": if_wide(half + F.col("__linemath")),
        "links": links(shown),
        "blockquotes": F.size(F.filter("__fold.lines", lambda x: x.rlike("(?U)" + P.QUOTED))).cast("bigint"),
        "thematic_breaks": rules.cast("bigint"),
        "bold": _pairs(shown, "**") + F.when(wide, zero).otherwise(_pairs(shown, "__")),
        "strikethrough": if_wide(_pairs(shown, "~~")),
        "inline_code": _count(F.col("__text"), P.CODE),
        "contains_rtl": F.col("__s").rlike(RTL_CLASS),
        "contains_ltr": F.col("__s").rlike("[A-Za-z]"),
        "contains_em_dash": F.col("__s").contains("—"),
        "bidi_controls": _count(F.col("__s"), CONTROL_CLASS),
        "syntax_errors": F.filter(
            F.array(F.when(F.col("__fold.mark") != "", "unclosed fenced code block"), F.when(wide & (F.col("__bare") % 2 == 1), "unclosed display-math block")), lambda x: x.isNotNull()
        ),
    }
    return step.withColumns({f"f_{k}": v for k, v in found.items()}).drop("__s", "__lines", "__fold", "__logical", "__text", "__shown", "__setext", "__bare", "__linemath", "__levels")


def preflight(docs: DataFrame, text: str = "text", source: Column | None = None) -> DataFrame:
    """docs with features, sha256, errors and valid."""
    step = with_features(docs, text, source)
    s = F.coalesce(F.col(text), F.lit(""))
    own = F.array(F.when(F.regexp_replace(s, r"^\x{FEFF}+", "").rlike(r"(?U)^\s*$"), "Markdown input is empty"), F.when(s.contains("\0"), "Markdown input contains a NUL character"))
    step = step.withColumn("sha256", F.sha2(s.cast("binary"), 256)).withColumn("errors", F.concat(F.filter(own, lambda x: x.isNotNull()), F.col("f_syntax_errors")))
    return step.withColumn("valid", F.size("errors") == 0)
