"""Operator 13: importance resampling towards a target distribution.

Features are hashed runs of words. Each bucket gains by how much commoner it is in the target
than in the corpus; a document's weight is the sum of the gains of its features, looked up in
one array. With a Gumbel variable added, the highest scores are a draw without replacement.
Scores are integers, so that the draw needs no sort of all rows: a histogram of scores,
summed from the top, tells the rank at which each score begins and the score at which the
draw ends; only rows from there on are numbered, by doc_id within their score.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BEFORE, prefix_sums, staged, table
from .merkle import CRC_TABLE, crc32_sql

BUCKETS, RUNS, LEAST, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: A-Z become small, and what parts words becomes a space.
_SIGNS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


class Hashed(dict):
    """Feature to bucket, remembered up to a bound of features."""

    def __init__(self, buckets: int, runs: int):
        self.buckets, self.runs = buckets, runs

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) < 300_000 and len(feature) < 64:
            self[feature] = bucket
        return bucket

    def of(self, text: str) -> np.ndarray:
        """The buckets of all features of a text, repeats included."""
        words = text.encode().translate(_SIGNS).split()
        found = [np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        for k in range(2, self.runs + 1):
            n = max(0, len(words) - k + 1)
            found.append(np.fromiter((self[b" ".join(words[i : i + k])] for i in range(n)), np.int64, n))
        return np.concatenate(found)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks count whole texts; the
    driver gets one number a bucket."""

    def counted(batches):
        hashed, sums = Hashed(buckets, runs), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                sums += np.bincount(hashed.of(value.as_py()), minlength=buckets)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(sums[there], pa.int64())], names=["bucket", "n"])

    found = texts.select(F.col(f"`{text}`").alias("t")).filter("t <> ''").mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, a thousand times the logarithm of how much commoner it is in the
    target, with one added to each count, rounded down."""
    n, s, t = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", runs: int = RUNS) -> DataFrame:
    """docs without its text, with n_features and weight (bigint)."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    others = [c for c in docs.columns if c not in (text, "n_features", "weight")]

    def work(batches):
        hashed = Hashed(len(shipped.value), runs)
        for batch in batches:
            found = [hashed.of(t.as_py() or "") for t in batch.column(len(others))]
            made = [pa.array([len(f) for f in found], pa.int64()), pa.array([int(shipped.value[f].sum()) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*others, "n_features", "weight"])

    step = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("__pl_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in step.schema if f.name != "__pl_text")
    return step.mapInArrow(work, f"{kept}, n_features bigint, weight bigint")


def drawn(scored: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """scored (staged): doc_id, n_features, score and more. Adds rank: 1, 2, 3... for the
    floor(percent * N / 100) highest scores of the N rows with at least `least` features, ties
    to the smaller doc_id, null ones last; null for all others. Rows that repeat a doc_id
    follow each other by their number of features; equal rows are interchangeable."""
    able = F.col("n_features") >= least
    counts = staged(scored.filter(able).groupBy("score").agg(F.count("*").alias("n")), "histogram")
    draw = percent * (counts.agg(F.sum("n")).first()[0] or 0) // 100
    counts = staged(prefix_sums(counts.withColumn("all", F.lit(0)), ["all"], [F.desc("score")], F.col("n")).select("score", F.col(BEFORE).alias("above")).filter(F.col("above") < draw), "offsets")
    cutoff = counts.agg(F.min("score")).first()[0]
    nobody = F.lit(None).cast("bigint")
    if cutoff is None:
        return scored.withColumn("rank", nobody)
    chosen = able & (F.col("score") >= cutoff)
    ranked = prefix_sums(scored.filter(chosen), ["score"], [F.asc_nulls_last("doc_id"), F.asc("n_features")], F.lit(1), counts)
    place = F.col("above") + F.col(BEFORE) + 1
    ranked = ranked.withColumn("rank", F.when(place <= draw, place)).drop(BEFORE, "above")
    return ranked.unionByName(scored.filter(~chosen).withColumn("rank", nobody))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, runs: int = RUNS, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs, drawn towards the
    texts of `target`. Null and empty texts have no features, the weight 0, and are never
    drawn where `least` is above 0; without any target texts all gains are those of counts of
    0. A null doc_id draws as an empty one. Repeated rows draw alike and are ranked one after
    another. Other columns of docs play no part; an empty table gives no rows."""
    gain = gains(bucket_counts(docs, "text", buckets, runs), bucket_counts(target, "text", buckets, runs))
    rows = weighed(docs.select("doc_id", "text"), gain, "text", runs)
    h = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")
    return drawn(staged(rows.withColumn("score", F.col("weight") + noise), "scored"), percent, least)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOUND = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BYTES = "[CAST('0x' || hex(encode(w))[2 * j + 1:2 * j + 2] AS BIGINT) FOR j IN range(strlen(w))]"
ORACLE_SQL = f"""WITH k AS (SELECT {CRC_TABLE} AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, {_FOUND} AS f FROM documents),
dw AS (SELECT r, unnest(f) AS w FROM d), bw AS (SELECT unnest({_FOUND}) AS w FROM benchmark),
v AS (SELECT w, {crc32_sql(_BYTES, 'k.t')} % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), k),
s AS (SELECT b, count(*) AS n FROM dw JOIN v USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN v USING (w) GROUP BY b),
z AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t),
g AS (SELECT v.w, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (z.s + {BUCKETS}) / ((coalesce(s.n, 0) + 1) * (z.t + {BUCKETS})))) AS BIGINT) AS gain FROM v CROSS JOIN z LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
x AS (SELECT d.doc_id, CAST(len(f) AS BIGINT) AS n_features, CAST(coalesce(q.weight, 0) AS BIGINT) AS weight, CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM d LEFT JOIN (SELECT r, sum(gain) AS weight FROM dw JOIN g USING (w) GROUP BY r) q ON q.r = d.r),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
o AS (SELECT *, CASE WHEN n_features >= {LEAST} THEN row_number() OVER (PARTITION BY n_features >= {LEAST} ORDER BY score DESC, doc_id, n_features) END AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM y WHERE n_features >= {LEAST}) // 100 THEN place END AS rank FROM o"""
