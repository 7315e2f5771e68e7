"""An audit of a repository of files: what should not be there, and what is missing.

Files are rows of path, text and content. Paths resolve by a fold with a stack of folders;
the terms of a list are sought together in one pass over each text; images are judged by the
first bytes of their content. All in the JVM.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES = "path string, text string, content binary"
SOURCES = "md py ps1 js json yml yaml xml toml".split()
#: A folder of one user on one machine.
MACHINE_PATH = r"(?i)\b[a-z]:[\\/]users[\\/][^\\/\s]+|(?<![\w.])/(?:users|home)/[^/\s]+/"
LINK = r"(?<!!)\[[^\]\n]*+\]\(([^)\n]++)\)"
_PNG, _IHDR = "89504E470D0A1A0A", "49484452"


def suffix(path: Column) -> Column:
    """The extension of a path, lower case, without its dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def resolved(path: Column) -> Column:
    """A path without `.`, `..` and double slashes. What climbs above the root keeps its `..`,
    so that it leads to no file."""
    up = lambda stack: F.when((F.size(stack) == 0) | (F.element_at(stack, -1) == ".."), F.concat(stack, F.array(F.lit("..")))).otherwise(F.slice(stack, F.lit(1), F.size(stack) - 1))
    step = lambda stack, part: F.when(part.isin("", "."), stack).when(part == "..", F.when(F.size(stack) > 0, up(stack)).otherwise(F.array(F.lit("..")))).otherwise(F.concat(stack, F.array(part)))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda stack: F.array_join(stack, "/"))


def terms_in(text: Column, terms: list[str]) -> Column:
    """Which of the terms (whatever their case) a text holds, sorted. One pattern tries all of
    them at each place, the longest first; terms within a term come with it."""
    small = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))
    if not small:
        return F.array().cast("array<string>")
    within = F.create_map(*[x for t in small for x in (F.lit(t), F.array(*[F.lit(s) for s in small if s in t]))])
    pattern = "(?=(" + "|".join(re.escape(t) for t in small) + "))"
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda t: within[t]))))


def png_size(content: Column) -> Column:
    """width and height of a PNG from its first 24 bytes; null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint")
    good = (F.octet_length(content) >= 24) & (F.hex(F.substring(content, 1, 8)) == _PNG) & (F.hex(F.substring(content, 13, 4)) == _IHDR)
    return F.when(good, F.struct(number(17).alias("width"), number(21).alias("height")))


def broken_links(files: DataFrame) -> DataFrame:
    """path and target of the relative links of Markdown files that lead to no file or folder.
    Parts after # do not count; equal links of a file count once."""
    raw = files.filter(suffix(F.col("path")) == "md").select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(LINK), F.lit(1)))).alias("raw"))
    target = F.trim(F.substring_index("raw", "#", 1))
    links = raw.select("path", target.alias("target")).filter((F.col("target") != "") & ~F.contains("target", F.lit("://")) & ~F.startswith("target", F.lit("mailto:"))).distinct()
    folder = F.when(F.startswith("target", F.lit("/")), "").otherwise(F.regexp_replace("path", "[^/]*$", ""))
    there = files.select(F.split(resolved(F.col("path")), "/").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("full")).distinct()
    return links.withColumn("full", resolved(F.concat(folder, F.col("target")))).join(there, "full", "left_anti").select("path", "target")


def audit(files: DataFrame, banned: list[str], expected: DataFrame | None = None, least: tuple[int, int] = (1000, 250)) -> DataFrame:
    """path, finding and detail, a row for each: generated (documents anywhere, archives at the
    root), machine_path, banned (a row for each term), broken_link, image (no PNG, or smaller
    than `least`), missing and unexpected (against `expected`: path, for its folders). Null
    texts and contents are empty ones; a clean repository gives no rows."""
    path, kind, text = F.col("path"), suffix(F.col("path")), F.coalesce("text", F.lit(""))
    generated = kind.isin("docx", "pdf") | (kind.isin("zip") & ~F.contains("path", F.lit("/")))
    size = png_size(F.coalesce("content", F.lit(b"")))
    small = F.when(size.isNull(), "no PNG").when((size["width"] < least[0]) | (size["height"] < least[1]), F.concat(size["width"].cast("string"), F.lit("x"), size["height"].cast("string")))
    row = lambda check, detail: F.struct(F.lit(check).alias("finding"), detail.alias("detail"))
    source = kind.isin(SOURCES + ["html"])
    found = F.concat(
        F.array(F.when(generated, row("generated", kind)), F.when(source & text.rlike(MACHINE_PATH), row("machine_path", F.regexp_extract(text, MACHINE_PATH, 0))), F.when((kind == "png") & small.isNotNull(), row("image", small))),
        F.when(source, F.transform(terms_in(text, banned), lambda t: row("banned", t))).otherwise(F.array()),
    )
    own = files.select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("path", "x.finding", "x.detail")
    every = [own, broken_links(files).select("path", F.lit("broken_link").alias("finding"), F.col("target").alias("detail"))]
    if expected is not None:
        folder = lambda p: F.regexp_replace(p, "[^/]*$", "")
        listed = expected.select("path").distinct()
        folders = listed.select(folder(path).alias("folder")).distinct()
        here = files.select("path", folder(path).alias("folder")).join(folders, "folder", "left_semi").select("path").distinct()
        nothing = F.lit(None).cast("string")
        every += [listed.join(here, "path", "left_anti").select("path", F.lit("missing").alias("finding"), nothing.alias("detail")), here.join(listed, "path", "left_anti").select("path", F.lit("unexpected").alias("finding"), nothing.alias("detail"))]
    return reduce(DataFrame.unionByName, every)
