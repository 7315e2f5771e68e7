"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.kernel.values import SYMBOLS

from .folds import let

RTL_CLASS = r"[\x{0590}-\x{08FF}]"
LTR_CLASS = r"[\p{IsAlphabetic}&&[^\x{0590}-\x{08FF}]]"
CONTROL_CLASS = r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
#: What the arrow rule takes for a fence.
FENCE_LINE = r"(?U)^\s*(?:```|~~~)"
#: Line ends as Python's splitlines() knows them.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def with_maqaf(text: Column) -> Column:
    """A hyphen between a Hebrew sign and a Latin letter becomes a maqaf; looks at the
    original neighbours, so it comes before the other folds."""
    return F.regexp_replace(text, r"([\x{0590}-\x{05FF}])-(?=[A-Za-z])", "$1־")


def without_em_dash(text: Column) -> Column:
    return F.translate(text, "—", "-")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_CLASS, "")


def folded(text: Column) -> Column:
    """Maqaf, em dash and direction controls, in the order that matters."""
    return without_controls(without_em_dash(with_maqaf(text)))


def unix_lines(text: Column) -> Column:
    """Line ends become \\n and lines lose trailing white space."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)(?<![ \t])[ \t]+$", "")


def lines_of(text: Column) -> Column:
    """The lines of a text, without an empty one at its end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def fence_flags(lines: Column) -> Column:
    """For each line: whether it is inside a fence by simple parity (any fence-looking line
    toggles), as the arrow rule needs it."""
    places = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(FENCE_LINE), i)), lambda i: i.isNotNull())
    edges = F.struct(F.concat(F.array(F.lit(0)), places).alias("starts"), F.concat(places, F.array(F.size(lines))).alias("ends"))
    return let(edges, lambda e: F.flatten(F.transform(e["starts"], lambda start, k: F.array_repeat(k % 2 == 1, F.get(e["ends"], k) - start))))


def contains_rtl(text: Column) -> Column:
    return text.rlike(RTL_CLASS)


def contains_ltr(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def _held(text: Column, kind: str) -> Column:
    """How many signs of a class a text holds: what it loses without their stretches, as an
    array of all of them, which regexp_count() builds, costs several times the text."""
    return (F.length(text) - F.length(F.regexp_replace(text, kind + "++", ""))).cast("bigint")


def rtl_count(text: Column) -> Column:
    return _held(text, RTL_CLASS)


def ltr_count(text: Column) -> Column:
    return _held(text, LTR_CLASS)


def dominant_rtl(text: Column) -> Column:
    """More right-to-left signs than other letters; ties are left-to-right."""
    return rtl_count(text) > ltr_count(text)


def strong_direction(sign: Column) -> Column:
    """rtl, ltr or null for one sign."""
    return F.when(sign.rlike(f"^{RTL_CLASS}"), "rtl").when(sign.rlike(f"^{LTR_CLASS}"), "ltr")


def clean_markdown(text: Column) -> Column:
    """The six rewrites after a capture. Leading spaces of every line go, as captured pages
    need it."""
    for pattern, by in (("\r", ""), ("(?<![ \t])[ \t]+\n", "\n"), ("\n[ \t]+", "\n"), ("\n{3,}", "\n\n"), (r"(?m)^[ \t]+|(?<![ \t])[ \t]+$", "")):
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def escape_markdown(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    text = F.regexp_replace(text, r"([`*_\[\]{}<>#$~^+=!])", r"\\$1")
    return F.regexp_replace(text, r"(^|\n)([ \t]*)([-+>])", r"$1$2\\$3")


def safe_filename(name: Column) -> Column:
    """Lower case, runs of other signs as one hyphen, none at the ends; llm if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_-]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("llm"))


def preview(text: Column, size: int = 90) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


def tokens(text: Column) -> Column:
    """Case-folded runs of letters and digits, as an array."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_numbers(text: Column) -> Column:
    """The different tokens of a text in order, and how often each occurs, as an array."""

    def counted(found: Column) -> Column:
        starts = F.filter(F.transform(found, lambda x, i: F.when((i == 0) | (x != F.get(found, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda a, j: F.struct(F.get(found, a).alias("token"), (F.coalesce(F.get(s, j + 1), F.size(found)) - a).cast("bigint").alias("n"))))

    return let(F.sort_array(tokens(text)), counted)


def xml_escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    for sign, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(sign), F.lit(by))
    return text


def math_symbol(command: Column) -> Column:
    """The sign of a LaTeX command, or null."""
    table = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    return F.try_element_at(table, command)


def padded_rows(rows: Column) -> Column:
    """Rows of cells, filled up with empty cells to the longest."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(r, i), F.lit(""))))


def table_markdown(rows: Column) -> Column:
    """A Markdown table from ragged rows of cells: pipes escaped, line ends as spaces."""
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    lines = F.transform(padded_rows(rows), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.array_max(F.transform(rows, F.size))), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def points(value: Column, unit: int) -> Column:
    """A size in points, with a decimal only where it is needed."""
    size = value / F.lit(float(unit))
    return F.when(size == F.floor(size), size.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", size))
