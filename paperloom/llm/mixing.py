"""Operator 12: a mix of sources by target weights. Built-in functions only.

Sources get shares of all words by weights, and no source more than a few times what it has.
A source first gives all of its documents as often as its target allows, then, for the rest,
those with the smallest keys: each document draws an exponential variable, divided by the
document's quality weight, so that better ones come earlier, and a running sum of sizes in
the order of the keys ends at the budget. Running sums are made over ranges of keys, so that
a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BEFORE, prefix_sums, staged, table

#: Weights of sources in their order, repeating; the most epochs; the seed of the draws.
WEIGHTS, MOST, SEED = (5, 2, 1), 3, "paperloom"
WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 13  # hex digits of a draw: 52 bits, which a double holds exactly


def words_of(text: Column) -> Column:
    """How many runs of signs other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def prose_weight(signs: Column, size: Column) -> Column:
    """A quality weight from 0.05 to 1 by the signs a word takes with what parts it from the
    next: prose has four to twelve, junk and runs of symbols have fewer or many more."""
    per_word = signs / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), per_word / 4.0, F.lit(12.0) / F.greatest(per_word, F.lit(1.0))))


def exponential_key(id: Column, weight: Column, seed: str) -> Column:
    """An exponential variable with the rate `weight`, by a hash of the id: the same in all runs."""
    drawn = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256), F.lit(1), F.lit(DIGITS)), 16, 10).cast("bigint")
    return -F.ln((drawn + 0.5) / float(16**DIGITS)) / weight


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: one row for each source, __pl_source (in the order of the weights) and
    source_size. Adds target, epochs (times that the whole source is taken) and rest (words
    beyond). Water-filling in closed form: with sources by cap over weight, the first that
    the level of the water leaves below its cap fixes the level for all that follow."""
    every, ranked = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("__pl_source")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(ranked) - 1) % len(weights))
    rows = sizes.withColumn("w", w).withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("all", F.sum("source_size").over(every))
    order = Window.orderBy(F.col("cap") / F.col("w"), "__pl_source")
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("all") - filled) / F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("below", F.col("level") * F.col("w") < F.col("cap"))
    fixed = F.first(F.when(F.col("below"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.coalesce(fixed * F.col("w"), F.col("cap"))
    words = F.floor(target + 0.5).cast("bigint")
    rows = rows.withColumn("target", target).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("bigint"))
    return rows.select("__pl_source", "source_size", "target", "epochs", (words - F.col("epochs") * F.col("source_size")).alias("rest"))


def mixed(docs: DataFrame, keep: list[str], source: str = "source", text: str = "text", id: str = "doc_id", weight: Column | None = None, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The columns `keep` of every row with size, source_size, target, epochs (times that the
    whole document is taken), part (words taken after them, from its start) and taken (words
    in all). `weight`: the quality weight, above 0; by default prose_weight().

    Each source's taken words are its target, rounded: the document in which a budget ends
    gives its first words only. Null and empty texts have no words and take part as such; null
    sources are one source, the last. Rows that repeat an id or have none are told apart by
    their key and size; equal rows are interchangeable. Without any words all targets are 0;
    an empty table gives no rows. Columns of docs that are not kept play no part, and the
    names of the results win over those of kept columns."""
    made = ["size", "source_size", "target", "epochs", "part", "taken"]
    kept = {f"__pl_k{i}": c for i, c in enumerate(keep) if c not in made}
    whole, size = F.col(f"`{text}`"), F.col("size")
    group = F.coalesce(F.concat(F.lit("a"), F.col(f"`{source}`").cast("string")), F.lit("b"))  # by code points, null last
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in kept.items()], group.alias("__pl_source"), F.col(f"`{id}`").alias("__pl_id"), words_of(whole).alias("size"), (weight if weight is not None else F.coalesce(F.length(whole), F.lit(0))).cast("double").alias("__pl_w"))
    scale = F.col("__pl_w") if weight is not None else prose_weight(F.col("__pl_w"), size)
    rows = staged(rows.withColumn("__pl_key", exponential_key(F.col("__pl_id"), scale, seed)).drop("__pl_w"), "sized")
    goals = staged(targets(rows.groupBy("__pl_source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    placed = prefix_sums(rows, ["__pl_source"], ["__pl_key", "__pl_id", "size"], size, goals)
    part = F.greatest(F.lit(0).cast("bigint"), F.least(size, F.col("rest") - F.col(BEFORE)))
    out = placed.withColumn("part", part).withColumn("taken", F.col("epochs") * size + F.col("part"))
    return out.select(*[F.col(n).alias(c) for n, c in kept.items()], *made)


def copies(mix: DataFrame, text: str = "text") -> DataFrame:
    """The texts of a mix (with its text kept): each document as often as it is taken, whole
    ones first by `epoch`, the part of a document as its first words. What gives no words is left out."""
    whole = mix.filter("epochs > 0").select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("epochs"))).alias("epoch"))
    words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    some = mix.filter("part > 0").select("*", (F.col("epochs") + 1).alias("epoch")).withColumn(text, F.when(F.col("part") < F.col("size"), words).otherwise(F.col(text)))
    return whole.filter("size > 0").unionByName(some)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "epochs", "part")


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce('a' || source, 'b') AS g, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, coalesce(length(text), 0) AS signs, CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:{DIGITS}] AS BIGINT) AS h FROM documents),
q AS (SELECT *, -ln((h + 0.5::DOUBLE) / {float(16**DIGITS)}::DOUBLE) / greatest(0.05::DOUBLE, least(1::DOUBLE, signs / greatest(size, 1) / 4, 12::DOUBLE / greatest(signs / greatest(size, 1), 1::DOUBLE))) AS key FROM d),
s AS (SELECT g, sum(size)::BIGINT AS source_size FROM d GROUP BY g),
w AS (SELECT *, [{', '.join(f'{float(x)}::DOUBLE' for x in WEIGHTS)}][(row_number() OVER (ORDER BY encode(g)) - 1) % {len(WEIGHTS)} + 1] AS w, ({MOST} * source_size)::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS a FROM s),
l AS (SELECT *, (a - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(g) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, encode(g) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT g, source_size, coalesce(first_value(CASE WHEN level * w < cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, encode(g) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * w, cap) AS target FROM l),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS words, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM f),
p AS (SELECT doc_id, size, source_size, target, epochs, greatest(0, least(size, words - epochs * source_size - coalesce(sum(size) OVER (PARTITION BY q.g ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS part FROM q JOIN b ON q.g = b.g)
SELECT doc_id, size, source_size, target, epochs * size + part AS taken, epochs, part FROM p"""
