"""Directions of mixed text in the JVM: mirrored arrows and stretches of one direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.kernel.values import CLOSERS, OPENERS

from .folds import let
from .text import FENCE_LINE, RTL_CLASS, fence_flags, folded

#: An escaped sign, a code span, a formula: what mirroring leaves alone in a line. Spans
#: that stay open run to the end of the line.
ISLAND = r"(?s)\\.?|`(?:\\.|[^`\\])*+(?:`|\\?\z)|\$(?:\\.|[^$\\])*+(?:\$|\\?\z)"
_RTL = r"\x{0590}-\x{08FF}"
_LTR = rf"\p{{IsAlphabetic}}&&[^{_RTL}]"
#: A stretch whose strong signs have one direction, with the neutral signs between them: all
#: up to the next sign of the other one, and back to the last of its own.
CORE = rf"[{_RTL}](?:[{_RTL}[^\p{{IsAlphabetic}}]]*[{_RTL}])?+|[{_LTR}](?:[^{_RTL}]*[{_LTR}])?+"
SEGMENT = "array<struct<text:string,rtl:boolean>>"
_PAIRS = sorted(CLOSERS.items())
_ALWAYS = "".join(sorted(OPENERS - set(CLOSERS)))


def mirrored_line(line: Column) -> Column:
    """A line with its arrows turned, but for those in code, in formulas and after a backslash."""
    pieces, islands = F.split(line, ISLAND, -1), F.regexp_extract_all(line, F.lit(ISLAND), F.lit(0))
    turned = lambda x: F.translate(x, "→←", "←→")
    return let(F.struct(pieces.alias("p"), islands.alias("i")), lambda c: F.array_join(F.transform(c["p"], lambda x, k: F.concat(turned(x), F.coalesce(F.get(c["i"], k), F.lit("")))), ""))


def mirrored(text: Column) -> Column:
    """Arrows of lines that hold right-to-left signs point the other way, outside of fences
    (by parity of fence lines), code and formulas."""
    changed = lambda x, inside: ~inside & x.rlike("[→←]") & x.rlike(RTL_CLASS)
    marked = lambda lines: let(fence_flags(lines), lambda flags: F.array_join(F.transform(lines, lambda x, i: F.when(changed(x, F.get(flags, i) | x.rlike(FENCE_LINE)), mirrored_line(x)).otherwise(x)), "\n"))
    return F.when(text.rlike("[→←]") & text.rlike(RTL_CLASS), let(F.split(text, "\n", -1), marked)).otherwise(text)


def normalised(text: Column) -> Column:
    """All that happens to a text before it is parsed; null stays null."""
    return let(folded(text), mirrored)


def _opener(neutral: Column) -> Column:
    """How many signs stand before the first opening mark that nothing closes; null without
    one. An opener is open where it stands after the last of its closers."""

    def of(opener, closer):
        tail = F.substring_index(neutral, closer, -1)
        return let(F.instr(tail, F.lit(opener)), lambda at: F.when(at > 0, F.length(neutral) - F.length(tail) + at - 1))

    first = [F.when(F.instr(neutral, F.lit(o)) > 0, of(o, c)) for o, c in _PAIRS]
    any_of = F.when(neutral.rlike(f"[{_ALWAYS}]"), F.length(F.regexp_extract(neutral, f"^[^{_ALWAYS}]*+", 0)))
    return F.when(neutral.rlike("[" + "".join("\\" + o for o, _ in _PAIRS) + _ALWAYS + "]"), F.array_min(F.array(*first, any_of)))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<!\s)\s++$", "")


def segments(text: Column, base_rtl: Column, fallback_rtl: Column) -> Column:
    """Stretches of one direction, an array of text and rtl, that together are the text. The
    run lengths of strong signs come from one pattern; the neutral signs between two
    directions are shared out by what stands on both sides: white space belongs to the side
    of the paragraph's own direction, closing marks to what they close, an opener that is
    not closed to what follows. Neutral signs at the ends join their neighbour; wholly
    neutral text takes the fallback; null and empty text has no stretches."""
    none = F.array().cast(SEGMENT)

    def cut(between, now, base):
        return let(F.coalesce(_opener(between), F.length(between)), lambda end: F.when((now != base) & (~now == base), F.length(_trimmed(F.left(between, end)))).otherwise(end))

    def joined(c, base_rtl, fallback_rtl):
        last = F.size(c["cores"]) - 1
        rtl = lambda i: F.get(c["cores"], i).rlike(f"^[{_RTL}]")
        cuts = F.transform(c["gaps"], lambda g, i: F.when(i == 0, 0).when(i == last + 1, F.length(g)).otherwise(cut(g, rtl(i - 1), base_rtl)))
        part = lambda k: F.transform(c["cores"], lambda core, i: F.struct(F.concat(F.substr(F.get(c["gaps"], i), F.get(k, i) + 1), core, F.left(F.get(c["gaps"], i + 1), F.get(k, i + 1))).alias("text"), core.rlike(f"^[{_RTL}]").alias("rtl")))
        return F.when(last < 0, F.array(F.struct(text.alias("text"), fallback_rtl.alias("rtl")))).otherwise(let(cuts, part)).cast(SEGMENT)

    cores = F.struct(F.regexp_extract_all(text, F.lit(CORE), F.lit(0)).alias("cores"), F.split(text, CORE, -1).alias("gaps"), base_rtl.alias("base"), fallback_rtl.alias("fallback"))
    return F.when(F.length(text) > 0, let(cores, lambda c: joined(c, c["base"], c["fallback"]))).otherwise(none)


def segment_rows(docs: DataFrame, text: str = "text", base_rtl: Column | None = None, fallback_rtl: Column | None = None) -> DataFrame:
    """A row for each stretch: the other columns of docs, place (from 0), start (code points),
    text and rtl. By default the paragraph's direction is that of most of its signs."""
    from .text import dominant_rtl

    whole = F.col(f"`{text}`")
    base = base_rtl if base_rtl is not None else dominant_rtl(F.coalesce(whole, F.lit("")))
    made = segments(whole, base, fallback_rtl if fallback_rtl is not None else base)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "place", "text", "rtl")]
    return docs.select(*kept, F.posexplode_outer(made).alias("place", "__s")).filter("place is not null").select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text, "place", "text", "rtl")], "place", "__s.text", "__s.rtl")
