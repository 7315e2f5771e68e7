"""Operator 2: personal data, by patterns, checksums and context words.

Regular expressions propose spans of each kind, validators confirm them (Luhn for
cards, mod-97 for IBANs, ranges for addresses and numbers) and words near a span
adjust its score. Only built-in functions are used: the places of matches follow from
the pieces that split() leaves between them, which serve as context as well.

The patterns give the same matches as the plain ones in BASE, but in linear time and
without recursion on long runs: loops are possessive where nothing that follows can
use what they hold, and a match may only start where a run starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.folds import emitting, let

from .common import table

#: The patterns that the base spans are defined by.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Lengths of account numbers by country, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
ADDED = {
    "iban": "|".join(f"(?:{'|'.join(c.split())})[0-9][0-9](?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()),
    "ssn": r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]",
}
KINDS = [*BASE, *ADDED]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    **ADDED,
}
#: What a text must hold for a kind at all; cheaper than the pattern.
NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": "[0-9](?:[ -]?[0-9]){11}",
    "phone": r"\+[0-9]",
    "iban": "[A-Z][A-Z][0-9][0-9]",
    "ssn": ADDED["ssn"],
}
#: Words that raise the score of a kind; they count as whole words, with a plural s or not.
CONTEXT = {
    "email": "mail|email|contact|write|schreib|schreiben|correo|courriel",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|visa|master|mastercard|amex|credit|debit|karte|kreditkarte|tarjeta|carte",
    "phone": "phone|telephone|tel|telefon|call|fax|mobile|handy",
    "iban": "iban|account|bank|konto|cuenta|compte|transfer",
    "ssn": "ssn|social|security|insurance|taxpayer",
}
WHOLE = {kind: f"(?:^|[^a-z])(?:{words})s?(?:[^a-z]|$)" for kind, words in CONTEXT.items()}
#: Score of a confirmed span, and what a context word within NEAR signs adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT_BONUS, NEAR, THRESHOLD = 0.2, 40, 0.5
BLOCK = 2048  # signs of a text that are cut out of together

_OCTET = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
SPAN = "struct<start:int,place:int,end:int,kind:string,match:string,score:double>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the letters and digits of an IBAN leave 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(rest, sign):
        code = F.ascii(sign)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _confirmed(kind: str, match: Column, before: Column, after: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":  # nothing that could belong to a longer number stands beside it
        alone = ~F.coalesce(F.right(before, F.lit(1)), F.lit("")).rlike("[A-Za-z0-9]") & ~F.coalesce(F.left(after, F.lit(1)), F.lit("")).rlike("[A-Za-z0-9]")
        return alone & mod97(F.replace(match, F.lit(" "), F.lit("")))
    apart = ~F.coalesce(F.right(before, F.lit(1)), F.lit("")).rlike("[0-9-]") & ~F.coalesce(F.left(after, F.lit(1)), F.lit("")).rlike("[0-9-]")
    return apart & ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-|-0000$")


def _score(kind: str, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
    return F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near.rlike(WHOLE[kind]), CONTEXT_BONUS).otherwise(0.0))


def _spans(kind: str, pieces: Column, found: Column) -> Column:
    """Confirmed spans of a kind from the pieces between matches and the matches."""
    none = F.array().cast(f"array<{SPAN}>")

    def walked(c):
        def step(at, i):
            start = at + F.length(F.get(c["pieces"], i))
            parts = F.struct(start.alias("start"), F.get(c["pieces"], i).alias("before"), F.get(c["pieces"], i + 1).alias("after"), F.get(c["found"], i).alias("match"))
            return let(parts, placed)

        def placed(x):
            end = x["start"] + F.length(x["match"])
            score = _score(kind, x["before"], x["after"])
            span = lambda s: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"), s.alias("score"))
            keep = _confirmed(kind, x["match"], x["before"], x["after"])
            least = THRESHOLD if kind in ADDED else 0.0
            return F.struct(end.alias("state"), F.when(keep, let(score, lambda s: F.when(s >= least, F.array(span(s)).cast(f"array<{SPAN}>")).otherwise(none))).otherwise(none).alias("out"))

        return emitting(F.sequence(F.lit(0), F.size(c["found"]) - 1), F.lit(0), "int", SPAN, step)["out"]

    return F.when(F.size(found) > 0, let(F.struct(pieces.alias("pieces"), found.alias("found")), walked)).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with `out`: all confirmed spans of the whole text by start, then kind, as
    structs of start, place (of the kind in KINDS), end (code points, exclusive), kind,
    match and score (0 to 1, raised by context words). Null and empty texts have none.
    Every row is returned once, rows that repeat an id too; other columns stay, a column
    named `out` is replaced. An empty table gives an empty result."""
    names = [f"__pl_{k}_{x}" for k in KINDS for x in ("pieces", "found")]
    none = F.array().cast("array<string>")
    step = docs.withColumn("__pl_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    cut = {}
    for kind, pattern in PATTERNS.items():
        needed = F.col("__pl_text").contains("@") if kind == "email" else F.col("__pl_text").rlike(NEEDS[kind])
        cut[f"__pl_{kind}_pieces"] = F.when(needed, F.split("__pl_text", pattern, -1)).otherwise(none)
        cut[f"__pl_{kind}_found"] = F.when(needed, F.regexp_extract_all("__pl_text", F.lit(pattern), F.lit(0))).otherwise(none)
    step = step.withColumns(cut)
    spans = F.concat(*[_spans(k, F.col(f"__pl_{k}_pieces"), F.col(f"__pl_{k}_found")) for k in KINDS])
    return step.withColumn(out, F.sort_array(spans)).drop("__pl_text", *names)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets, overlapping ones by that of
    the first; all rows and columns stay, repeated ids and extra columns too. A null text
    stays null, an empty one empty."""
    whole = F.col(f"`{text}`")

    def marked(c):
        def stretch(start, n):  # out of blocks, so that no piece is sought from the start of the text
            first, last = F.floor(start / BLOCK).cast("int"), F.floor((start + n - 1) / BLOCK).cast("int")

            def part(block, j):
                left = F.when(j == 0, F.pmod(start, F.lit(BLOCK))).otherwise(0)
                right = F.when(j == last - first, F.pmod(start + n - 1, F.lit(BLOCK)) + 1).otherwise(BLOCK)
                return F.substr(block, left + 1, right - left)

            return F.when(n > 0, F.array_join(F.transform(F.slice(c["blocks"], first + 1, last - first + 1), part), "")).otherwise("")

        def step(at, span):
            mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
            pieces = F.when(span["start"] >= at, F.array(stretch(at, span["start"] - at), mark)).otherwise(F.array().cast("array<string>"))
            return F.struct(F.greatest(at, span["end"]).alias("state"), pieces.alias("out"))

        return let(emitting(c["spans"], F.lit(0), "int", "string", step), lambda done: F.array_join(F.concat(done["out"], F.array(stretch(done["state"], c["n"] - done["state"]))), ""))

    blocks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    out = let(F.struct(F.col("__pl_pii").alias("spans"), blocks.alias("blocks"), F.length(whole).alias("n")), marked)
    found = find_pii(docs, text, "__pl_pii")
    return found.withColumn(text, F.when(F.size("__pl_pii") > 0, out).otherwise(whole)).drop("__pl_pii")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = list(BASE)
    of_kind = lambda k: F.filter("pii", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in kinds]
    base = F.filter("pii", lambda s: s["place"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"))


def _oracle() -> str:
    both = {**BASE, **ADDED}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    iban = "replace(m, ' ', '')"
    turned = f"({iban}[5:] || {iban}[1:4])"
    keep = {
        "email": "true",
        "ip": f"regexp_full_match(m, '{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}')",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN CASE WHEN CAST({digits}[-i] AS INT) > 4 THEN 2 * CAST({digits}[-i] AS INT) - 9 ELSE 2 * CAST({digits}[-i] AS INT) END ELSE CAST({digits}[-i] AS INT) END FOR i IN range(1, length({digits}) + 1)]) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"NOT regexp_matches(right(p, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(q, 1), '[A-Za-z0-9]') AND list_reduce([CASE WHEN ascii({turned}[i]) >= 65 THEN ascii({turned}[i]) - 55 ELSE ascii({turned}[i]) - 48 END FOR i IN range(1, length({turned}) + 1)], lambda a, x: (a * (CASE WHEN x >= 10 THEN 100 ELSE 10 END) + x) % 97) = 1",
        "ssn": f"NOT regexp_matches(right(p, 1), '[0-9-]') AND NOT regexp_matches(left(q, 1), '[0-9-]') AND NOT regexp_matches(m, '^(?:000|666|9)') AND NOT regexp_matches(m, '-00-|-0000$') AND regexp_matches(lower(right(p, {NEAR}) || ' ' || left(q, {NEAR})), '{WHOLE['ssn']}')",
    }
    parts = []
    for place, (kind, pattern) in enumerate(both.items()):
        pattern = pattern.replace(r"\x20", " ")
        parts.append(f"""SELECT r, '{kind}' AS kind, {place} AS place, p, q, m, e - length(m) AS s, e, {keep[kind]} AS ok, CAST(least(100, {100 * PRIOR[kind]:.0f} + CASE WHEN regexp_matches(lower(right(p, {NEAR}) || ' ' || left(q, {NEAR})), '{WHOLE[kind]}') THEN {100 * CONTEXT_BONUS:.0f} ELSE 0 END) AS INT) AS score FROM (
  SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
    SELECT r, i, pieces[i] AS p, pieces[i + 1] AS q, found[i] AS m FROM (
      SELECT r, pieces, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT r, regexp_split_to_array(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS found FROM d WHERE regexp_matches(t, '{pattern}')))))""")
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, place) AS scores FROM (SELECT r, kind, place, score, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM a WHERE ok) GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g ON d.r = g.r"""


ORACLE_SQL = _oracle()
