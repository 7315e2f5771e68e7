"""Multisets of tokens, compared without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.folds import let
from paperloom.functions.text import token_numbers, tokens


#: Keys of several rows that are sent to all tasks; with more of them, all rows are shuffled.
REPEATED = 100_000


def _by_key(rows: DataFrame, key: str, alone: Callable[[DataFrame], DataFrame], grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """alone(rows) of the rows whose key no other row has, which need no shuffle, and grouped(rows) of
    the others. The keys are counted first."""
    repeated = rows.groupBy(key).agg(F.count("*").alias("__pl_n")).where("__pl_n > 1").select(F.col(key).alias("__pl_key"))
    found = repeated.limit(REPEATED + 1).count()
    if found > REPEATED:
        return grouped(rows)
    if not found:
        return alone(rows)
    among = F.col(key).eqNullSafe(F.col("__pl_key"))
    return alone(rows.join(F.broadcast(repeated), among, "left_anti")).unionByName(grouped(rows.join(F.broadcast(repeated), among, "left_semi")))


def token_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, n. The tokens of a row are counted where it is; only rows that share their key
    with others are exploded and summed in a shuffle. docs is read twice, once for its keys."""
    rows = docs.select(key, text)
    grouped = lambda some: some.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    return _by_key(rows, key, lambda some: some.select(key, F.inline(token_numbers(F.col(text)))), grouped)


def fidelity(pairs: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """key, expected_tokens, missing_tokens, token_coverage of rows that hold both texts.

    The tokens of a row whose key no other row has are compared where it is. Rows that share
    their key are counted in one aggregation of signed tokens on (key, token), so there is no join; a
    second one sums per key. A row without expected tokens has coverage 1."""
    rows = pairs.select(key, F.coalesce(expected, F.lit("")).alias("__pl_e"), F.coalesce(actual, F.lit("")).alias("__pl_a"))
    sums = _by_key(rows, key, lambda some: _compared(some, key), lambda some: _summed(some, key))
    share = (F.col("expected_tokens") - F.col("missing_tokens")) / F.col("expected_tokens")
    return sums.withColumn("token_coverage", F.when(F.col("expected_tokens") == 0, F.lit(1.0)).otherwise(share))


def _compared(rows: DataFrame, key: str) -> DataFrame:
    """A token that both sides have is followed by that of the other side."""
    side = lambda text, i: F.transform(token_numbers(F.col(text)), lambda t: F.struct(t["token"].alias("token"), F.lit(i).alias("side"), t["n"].alias("n")))
    total = lambda counts: F.aggregate(counts, F.lit(0).cast("bigint"), lambda x, y: x + y)

    def summed(both):
        found = lambda x, i: F.when(F.get(both, i + 1)["token"] == x["token"], F.get(both, i + 1)["n"]).otherwise(F.lit(0).cast("bigint"))
        wanted = F.filter(both, lambda x: x["side"] == 0)
        missing = F.transform(both, lambda x, i: F.when(x["side"] == 0, F.greatest(x["n"] - found(x, i), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")))
        return F.struct(total(F.transform(wanted, lambda x: x["n"])).alias("expected_tokens"), total(missing).alias("missing_tokens"))

    both = F.sort_array(F.concat(side("__pl_e", 0), side("__pl_a", 1)))
    return rows.select(key, let(both, summed).alias("__pl_x")).select(key, "__pl_x.expected_tokens", "__pl_x.missing_tokens")


def _summed(rows: DataFrame, key: str) -> DataFrame:
    side = lambda text, i: F.transform(tokens(F.col(text)), lambda t: F.struct(t.alias("token"), F.lit(i).alias("side")))
    signed = rows.select(key, F.explode(F.concat(side("__pl_e", 1), side("__pl_a", 0), F.array(F.struct(F.lit("").alias("token"), F.lit(2).alias("side"))))).alias("x"))
    counts = signed.groupBy(key, "x.token").agg(F.sum((F.col("x.side") == 1).cast("bigint")).alias("e"), F.sum((F.col("x.side") == 0).cast("bigint")).alias("a"))
    return counts.groupBy(key).agg(F.sum("e").alias("expected_tokens"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0).cast("bigint"))).alias("missing_tokens"))
