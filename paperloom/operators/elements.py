"""Pages as tables of elements, each an interval of its page, and joins over intervals.

A page is cut into tags by one pattern; a fold with a stack of open elements gives every
element its interval, its depth and its parent, whatever is left unclosed. Intervals of a
page nest, so that "inside" is a question of running maxima: of the ends of all elements of
one kind that begin earlier, the largest tells whether one of them still holds the place.

Rules of the tree: void elements and self-closed tags end where they stand; script, style
and others of RAW hold no tags; a start tag closes what CLOSES says unless a wall is nearer;
an end tag closes the nearest open element of its name and all that is open in it, or
nothing; what is open at the end of the page ends there. Where DEEPEST elements are open, a
further one closes the innermost. A tag or comment without an end runs to the end of the page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import dialect
from paperloom.functions.folds import emitting, let
from paperloom.kernel.capture import PROVIDERS
from paperloom.sources.sinks import shared_path

DEEPEST = 512
VOID = "area base br col embed hr img input link meta source track wbr".split()
RAW = "script style noscript title textarea iframe".split()
_WALLS = ["ul", "ol", "table", "dl", "select"]
#: A start tag, the open elements that it closes, and those that keep it from doing so.
CLOSES = {
    **{t: (closed, [w for w in _WALLS if w != t]) for t, closed in {"li": ["li"], "p": ["p"], "tr": ["tr"], "td": ["td", "th"], "th": ["td", "th"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option"]}.items()},
    **{t: (["p"], ["td", "th", "li", "div", "article", "section"]) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
_BLANK = r"\t\n\f\r "


def tag_pattern(once: str = "+") -> str:
    """What counts as one tag: an element of RAW with its text, a comment, any other tag.
    `once` makes loops possessive, where the engine has them."""
    inner = f"""(?:"[^"]*{once}(?:"|\\z)|'[^']*{once}(?:'|\\z)|[^'">])*{once}"""
    raw = "|".join(f"<{t}(?:[{_BLANK}/]{inner})?>.*?(?:</{t}[{_BLANK}]*>|\\z)" for t in RAW)
    return f"(?is)<!--.*?(?:-->|\\z)|{raw}|</?[a-z]{inner}(?:>|\\z)|<[!?/][^>]*{once}(?:>|\\z)"


NAME = f"^</?([A-Za-z][^{_BLANK}/>]*)"
ENTITY = "&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
SPACE = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NBSP = "&(?:nbsp|#160|#[xX][aA]0);"
HEAD = f"""(?s)^<[A-Za-z][^{_BLANK}/>]*((?:"[^"]*+(?:"|\\z)|'[^']*+(?:'|\\z)|[^'">])*+)"""
ATTRIBUTE = f"""([^{_BLANK}"'>/=]+)(?:[{_BLANK}]*=[{_BLANK}]*("[^"]*"?|'[^']*'?|[^{_BLANK}"'>]+))?"""
ELEMENT = "struct<id:int,name:string,start:int,stop:int,depth:int,parent:int,signs:int,tag:string>"
_OPEN = "struct<name:string,id:int,start:int,signs:int>"
_STATE = f"struct<stack:array<{_OPEN}>,at:int,seen:int>"


def signs_of(text: Column) -> Column:
    """How many signs other than white space a stretch of text shows; an entity is one."""
    return F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, NBSP, " "), ENTITY, "x"), SPACE, ""))


def _last(stack: Column, names: Column) -> Column:
    """The place (from 1) of the innermost open element of one of these names; 0 if none."""
    return F.coalesce(F.array_max(F.transform(stack, lambda e, i: F.when(F.array_contains(names, e["name"]), i + 1))), F.lit(0))


def with_elements(pages: DataFrame, html: str = "html", out: str = "elements") -> DataFrame:
    """pages with `out`: all elements of the page as structs of id (the number of its tag),
    name (lower case), start and stop (code points, stop exclusive), depth (from 1), parent
    (its id, null at the top), signs (shown, other than white space) and tag (as it stands).
    Null and empty pages have none. All in the JVM, one fold a page, no shuffle."""
    none = F.array().cast("array<string>")
    rules = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(F.array(*map(F.lit, x[0])).alias("t"), F.array(*map(F.lit, x[1])).alias("w")) for k, v in CLOSES.items() for x in (k, v)])

    def tag(pieces, t, i):
        name, ends = F.lower(F.regexp_extract(t, NAME, 1)), F.substr(t, F.lit(2), F.lit(1)) == "/"
        alone = name.isin(["", *VOID, *RAW]) | F.endswith(t, F.lit("/>"))
        rule = F.try_element_at(rules, name)
        return F.struct(
            i.alias("id"), name.alias("name"), ends.alias("ends"), alone.alias("alone"), F.length(t).alias("n"), F.length(F.get(pieces, i)).alias("gap"), signs_of(F.get(pieces, i)).alias("signs"),
            F.when(ends, F.array(name)).otherwise(F.coalesce(rule["t"], none)).alias("targets"), F.when(ends, none).otherwise(F.coalesce(rule["w"], none)).alias("walls"),
        )

    def closed(stack, kept, at, stop, seen):
        """What ends when only `kept` elements stay open; the outermost of them ends at `stop`."""
        return F.transform(
            F.slice(stack, kept + 1, F.size(stack)),
            lambda e, j: F.struct(e["id"].alias("id"), e["name"].alias("name"), e["start"].alias("start"), F.when(j == 0, stop).otherwise(at).alias("stop"), (kept + j + 1).alias("depth"), F.get(stack, kept + j - 1)["id"].alias("parent"), (seen - e["signs"]).alias("signs"), F.lit(None).cast("string").alias("tag")),
        ).cast(f"array<{ELEMENT}>")

    def fold(state, t):
        stack, at, seen = state["stack"], state["at"] + t["gap"], state["seen"] + t["signs"]
        found = F.when(F.size(t["targets"]) > 0, let(_last(stack, t["targets"]), lambda p: F.when((p > 0) & (p > _last(stack, t["walls"])), p - 1).otherwise(F.size(stack)))).otherwise(F.size(stack))
        kept = F.when(~t["ends"] & ~t["alone"], F.least(found, F.lit(DEEPEST - 1))).otherwise(found)

        def after(k):
            own = F.struct(t["name"].alias("name"), t["id"].alias("id"), at.alias("start"), seen.alias("signs")).cast(_OPEN)
            opened = F.when(t["ends"] | t["alone"], F.slice(stack, F.lit(1), k)).otherwise(F.concat(F.slice(stack, F.lit(1), k), F.array(own)))
            single = F.struct(t["id"].alias("id"), t["name"].alias("name"), at.alias("start"), (at + t["n"]).alias("stop"), (k + 1).alias("depth"), F.when(k > 0, F.get(stack, k - 1)["id"]).alias("parent"), F.lit(0).alias("signs"), F.lit(None).cast("string").alias("tag"))
            ended = F.when(k < F.size(stack), closed(stack, k, at, F.when(t["ends"], at + t["n"]).otherwise(at), seen)).otherwise(F.array().cast(f"array<{ELEMENT}>"))
            more = F.when(t["alone"] & ~t["ends"], F.array(single)).otherwise(F.array()).cast(f"array<{ELEMENT}>")
            moved = F.struct(opened.alias("stack"), (at + t["n"]).alias("at"), seen.alias("seen"))
            return F.struct(moved.alias("state"), F.concat(ended, more).alias("out"))

        return let(kept, after)

    begun = F.struct(F.array().alias("stack"), F.lit(0).alias("at"), F.lit(0).alias("seen")).cast(_STATE)

    def ended(cut, done):
        left, rest = done["state"], F.element_at(cut["pieces"], -1)
        end, seen = left["at"] + F.length(rest), left["seen"] + signs_of(rest)
        every = let(F.struct(end.alias("end"), seen.alias("seen")), lambda x: F.concat(done["out"], closed(left["stack"], F.lit(0), x["end"], x["end"], x["seen"])))
        named = F.transform(every, lambda e: F.struct(*[(F.get(cut["tags"], e["id"]) if c == "tag" else e[c]).alias(c) for c in ("id", "name", "start", "stop", "depth", "parent", "signs", "tag")]))
        return F.filter(named, lambda e: e["name"] != "")

    # one expression that binds each step once: a plan that copies it copies no work inside it
    text, pattern = F.coalesce(F.col(f"`{html}`"), F.lit("")), tag_pattern()
    cut = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("tags"))
    made = let(cut, lambda c: let(F.transform(c["tags"], lambda t, i: tag(c["pieces"], t, i)), lambda tags: let(emitting(tags, begun, _STATE, ELEMENT, fold), lambda done: ended(c, done))))
    return pages.withColumn(out, made)


def element_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each element, with the other columns of pages."""
    found = with_elements(pages, html, "__elements")
    return found.select(*[F.col(f"`{c}`") for c in pages.columns if c != html], F.inline_outer("__elements")).filter("id is not null")  # outer: no second fold to find out which are empty


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, without its quotes; empty where it has none, null
    where the tag lacks it. The first of several counts."""
    head = F.regexp_extract(tag, HEAD, 1)
    names, found = F.regexp_extract_all(head, F.lit(ATTRIBUTE), F.lit(1)), F.regexp_extract_all(head, F.lit(ATTRIBUTE), F.lit(2))
    place = F.array_position(F.transform(names, F.lower), F.lit(name))
    return F.when(place > 0, F.regexp_replace(F.get(found, (place - 1).cast("int")), "^[\"']|[\"']$", ""))


def compound_holds(part: str, element: Column, attrs: Column) -> Column:
    """Whether an element matches one part of a selector: a name, classes, attributes.
    attrs: a map of its attributes."""
    holds = F.lit(True)
    for attr, star, value, css_class, name in re.findall(r'\[([\w-]+)(?:(\*?)="([^"]*)")?\]|\.([\w-]+)|^([\w-]+)', part):
        if name:
            holds = holds & (element["name"] == name)
        elif css_class:
            spaced = F.concat(F.lit(" "), F.regexp_replace(F.try_element_at(attrs, F.lit("class")), f"[{_BLANK}]", " "), F.lit(" "))
            holds = holds & F.coalesce(F.contains(spaced, F.lit(f" {css_class} ")), F.lit(False))
        else:
            found = F.try_element_at(attrs, F.lit(attr))
            holds = holds & F.coalesce(found.isNotNull() if not value else F.contains(found, F.lit(value)) if star else found == value, F.lit(False))
    return holds


_READ = ["class", "style", "aria-hidden"] + sorted({a for _, _, selectors in PROVIDERS.values() for s in selectors for a in re.findall(r"\[([\w-]+)", s)} - {"class"})


def _attributes(tag: Column) -> Column:
    """The attributes that selectors and visibility ask for, as a map; parsed only where one
    of their names occurs at all."""
    head = F.regexp_extract(tag, HEAD, 1)
    names, found = F.transform(F.regexp_extract_all(head, F.lit(ATTRIBUTE), F.lit(1)), F.lower), F.regexp_extract_all(head, F.lit(ATTRIBUTE), F.lit(2))
    value = lambda a: let(F.array_position(names, F.lit(a)), lambda p: F.when(p > 0, F.regexp_replace(F.get(found, (p - 1).cast("int")), "^[\"']|[\"']$", "")))
    return F.create_map(*[x for a in _READ for x in (F.lit(a), value(a))])


def visible(attrs: Column) -> Column:
    """Neither hidden from readers nor by a style of its own."""
    style = F.lower(F.regexp_replace(F.coalesce(F.try_element_at(attrs, F.lit("style")), F.lit("")), f"[{_BLANK}]", ""))
    return ~(F.coalesce(F.try_element_at(attrs, F.lit("aria-hidden")) == "true", F.lit(False)) | style.contains("display:none") | style.contains("visibility:hidden"))


def inside(rows: DataFrame, keys: list[str], outer: Column, out: str) -> DataFrame:
    """rows (keys, start, stop of elements that nest) with `out`: whether a row for which
    `outer` holds, other than the element itself, holds the row's element: a structural join
    as one running maximum, in time that grows with the rows, however deep they nest."""
    earlier = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.max(F.when(outer, F.col("stop"))).over(earlier) >= F.col("stop"), F.lit(False)))


def answers(pages: DataFrame, html: str = "html", url: str = "url", provider: Column | None = None) -> DataFrame:
    """For each page that may be captured and has an answer: all columns of pages with
    provider, selector (its place among those of the provider), start and stop of the answer
    and its text. The first selector with a visible element of more than one sign of text
    counts, and the last such element. Pages that are alike in url and html are one to the
    join in between and stay as many rows; null pages have no answer."""
    allowed = pages.filter(dialect.can_capture(F.col(f"`{url}`"))).withColumn("provider", provider if provider is not None else dialect.provider(dialect.host_of(F.col(f"`{url}`"))))
    allowed = allowed.withColumn("__key", F.xxhash64(F.col(f"`{html}`"), "provider"))
    chosen = F.col("provider")
    found = element_rows(allowed.select("__key", "provider", F.col(f"`{html}`").alias("__html")), "__html").filter(F.col("tag").rlike("(?i)" + "|".join(_READ)) | F.col("name").isin(*{n for _, _, s in PROVIDERS.values() for x in s for n in re.findall(r"(?:^| )([\w-]+)", x)}))
    element = F.struct("name")
    hits = F.lit(None)
    for name, (_, _, selectors) in PROVIDERS.items():
        parts = [F.when(compound_holds(part, element, F.col("__attrs")), F.struct(F.lit(rank).alias("rank"), F.lit(k).alias("step"), F.lit(len(s.split()) - 1).alias("last"))) for rank, s in enumerate(selectors) for k, part in enumerate(s.split())]
        hits = F.when(chosen == name, F.filter(F.array(*parts), lambda h: h.isNotNull())).otherwise(hits)
    rows = found.withColumn("__attrs", _attributes(F.col("tag"))).withColumn("__seen", visible(F.col("__attrs"))).select("__key", "provider", "start", "stop", "signs", "__seen", F.explode(hits).alias("hit")).select("*", "hit.rank", "hit.step", "hit.last")
    rows = rows.withColumn("__in", F.col("step") == 0)
    for k in range(1, max(len(s.split()) for _, _, selectors in PROVIDERS.values() for s in selectors)):
        rows = inside(rows, ["__key", "provider", "rank"], F.col("__in") & (F.col("step") == k - 1), "__held")
        rows = rows.withColumn("__in", F.when(F.col("step") == k, F.col("__held")).otherwise(F.col("__in")))
    best = rows.filter(F.col("__in") & (F.col("step") == F.col("last")) & F.col("__seen") & (F.col("signs") > 1)).groupBy("__key", "provider").agg(F.min(F.struct("rank", (-F.col("start")).alias("back"), "stop")).alias("best"))
    joined = allowed.join(best, ["__key", "provider"])
    start, stop = -F.col("best.back"), F.col("best.stop")
    inner = F.substr(F.col(f"`{html}`"), start + 1, stop - start)
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("provider", "selector", "start", "stop", "text")]
    return joined.select(*kept, "provider", F.col("best.rank").alias("selector"), start.alias("start"), stop.alias("stop"), shown_text(inner).alias("text"))


def shown_text(html: Column) -> Column:
    """The text of a stretch of a page: tags go, the commonest entities become signs."""
    text = F.regexp_replace(html, tag_pattern(), "")
    for name, sign in (("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return text


def ancestry(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every element with the columns of pages, id, name, depth and what its ancestors say:
    path (names from the top, joined by /), list_depth (lists around it, itself included) and
    ordinal (its place among its siblings, from 1). A recursive query walks down the parent
    links, one level a round, DEEPEST rounds at most; the elements are written to the shared
    folder first, so that no round parses a page again. Pages alike in all columns count once.
    Sets spark.sql.cteRecursionRowLimit to no limit: results grow with the pages."""
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in (html, "id", "name", "depth", "path", "list_depth", "ordinal")]
    rows = pages.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(kept)], F.col(f"`{html}`").alias("__html"), F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]).alias("__key"))
    rows = element_rows(rows, "__html").drop("signs", "tag", "stop").distinct()
    among = Window.partitionBy("__key", "parent").orderBy("start")
    path = shared_path(spark, "elements")
    rows.withColumn("ordinal", F.row_number().over(among)).withColumn("lists", F.col("name").isin("ul", "ol").cast("int")).write.parquet(path)
    staged, view = spark.read.parquet(path), "paperloom_" + re.sub(r"[^a-z0-9]", "_", path.rsplit("/", 1)[-1].lower())
    staged.createOrReplaceTempView(view)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    own = "".join(f"__k{i}, " for i in range(len(kept)))
    found = spark.sql(f"""WITH RECURSIVE walk MAX RECURSION LEVEL {DEEPEST + 1} AS (
        SELECT __key, {own}id, name, depth, name AS path, lists AS list_depth, ordinal FROM {view} WHERE parent IS NULL
        UNION ALL SELECT e.__key, {"".join(f"e.__k{i}, " for i in range(len(kept)))}e.id, e.name, e.depth, concat(walk.path, '/', e.name), walk.list_depth + e.lists, e.ordinal FROM walk JOIN {view} e ON e.__key = walk.__key AND e.parent = walk.id)
        SELECT * FROM walk""")
    return found.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], "id", "name", "depth", "path", "list_depth", "ordinal")
