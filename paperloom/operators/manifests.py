"""Manifests of large tables, compared range by range.

A manifest holds a row's key, the digest of its content and the range that a hash of the key
puts it in. Ranges are the leaves of a tree of digests, kept beside the rows: two manifests
are compared from the root down, and only the ranges that differ are read, through partition
filters. Rows of equal ranges are never joined, however large the table is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges of a manifest as a power of two, and children of a node of its tree as well.
DEPTH, FAN = 8, 4


def digest_of(*columns: Column) -> Column:
    """One digest of several values; nulls are told from empty texts, and values that run
    into each other from others that do."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest(rows: DataFrame, key: Column, *content: Column, depth: int = DEPTH) -> DataFrame:
    """key (as text), digest and span, the range (0 to 2 ** depth - 1) by the key's hash. Rows
    that repeat a key count as one, whose digest is that of all their digests, sorted."""
    one = rows.select(key.cast("string").alias("key"), digest_of(*content).alias("digest"))
    each = one.groupBy("key").agg(F.sort_array(F.collect_list("digest")).alias("d"))
    digest = F.when(F.size("d") == 1, F.get("d", F.lit(0))).otherwise(F.sha2(F.array_join("d", "").cast("binary"), 256))
    return each.select("key", digest.alias("digest"), F.pmod(F.xxhash64("key"), F.lit(1 << depth)).cast("int").alias("span"))


def tree(spans: DataFrame, depth: int = DEPTH, fan: int = FAN) -> DataFrame:
    """level (0: the root), place and digest of every node over spans (span, digest, n): a
    node is the digest of its children in their order. Its size is that of the ranges."""
    level, now, out = depth, spans.select(F.col("span").cast("int").alias("place"), "digest"), []
    out.append(now.select(F.lit(level).alias("level"), "place", "digest"))
    while level > 0:
        step = min(fan, level)
        level -= step
        child = F.struct("place", "digest")
        now = now.groupBy(F.shiftright("place", step).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c")).select(F.col("up").alias("place"), F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["digest"])), ",").cast("binary"), 256).alias("digest"))
        out.append(now.select(F.lit(level).alias("level"), "place", "digest"))
    return reduce(DataFrame.unionByName, out)


def write(made: DataFrame, path: str, depth: int = DEPTH) -> None:
    """A manifest under `path`: rows, one folder for each range, and the tree above them. The
    digest of a range is that of its rows, sorted by key."""
    spark = made.sparkSession
    made.repartition("span").write.partitionBy("span").mode("overwrite").parquet(f"{path}/rows")
    stored = _rows(spark, path)
    # sums of hashes, so that no task holds a range: 4 x 60 bits of every row's own digest
    word = lambda i: F.sum(F.conv(F.substr("h", F.lit(15 * i + 1), F.lit(15)), 16, 10).cast("decimal(38,0)")).alias(f"w{i}")
    summed = stored.withColumn("h", F.sha2(F.concat("key", F.lit(":"), "digest").cast("binary"), 256)).groupBy("span").agg(*[word(i) for i in range(4)], F.count("*").alias("n"))
    spans = summed.select("span", digest_of(*[F.col(f"w{i}") for i in range(4)], F.col("n")).alias("digest"))
    tree(spans, depth).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")  # as long as the ranges


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, digest string, span int").parquet(f"{path}/rows")


def changed_spans(spark: SparkSession, old: str, new: str) -> list[int]:
    """The ranges in which two manifests differ, found from the root down: of each level only
    the children of nodes that differ are looked at."""
    trees = [spark.read.schema("level int, place int, digest string").parquet(f"{p}/tree") for p in (old, new)]
    levels = sorted(r.level for r in trees[0].select("level").union(trees[1].select("level")).distinct().collect())
    differing, before = [0], 0
    for level in levels:
        a, b = (t.filter((F.col("level") == level) & F.shiftright("place", level - before).isin(differing)).select("place", F.col("digest").alias(n)) for t, n in zip(trees, "ab", strict=True))
        differing, before = sorted(r.place for r in a.join(b, "place", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("place").collect()), level  # at most one for each range
        if not differing:
            return []
    return differing


def compare(spark: SparkSession, old: str, new: str) -> DataFrame:
    """key and state (changed, missing, unexpected) of what differs between two manifests in
    files. Only ranges whose digests differ are read; equal manifests read no rows at all."""
    spans = changed_spans(spark, old, new)
    a, b = (_rows(spark, p).filter(F.col("span").isin(spans) if spans else F.lit(False)).select("span", "key", F.col("digest").alias(n)) for p, n in ((old, "a"), (new, "b")))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").otherwise("changed")
    return a.join(b, ["span", "key"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("key", state.alias("state"))
