"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Up to so many edges (16 bytes each) one task finds the components; beyond, all do.
SMALL = 500_000


def _stars(edges: DataFrame, upwards: bool) -> DataFrame:
    """One half of a round: every node's neighbours (upwards: the larger ones; else the
    smaller ones and the node itself) are tied to the smallest of all."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if upwards else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if upwards:
        out = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _united(batches):
    """Union-find over all edges of a small table."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    ids = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], names=["id", "label"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """edges: a, b (bigint). Returns id, label for every id with an edge: label is the
    smallest id of its component. Small tables, by their counted size, take one task; for
    others, alternating large and small stars: the number of
    rounds grows with the logarithm of the size, each is written to the shared folder."""
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= small:
        return edges.repartition(1).mapInArrow(_united, "id bigint, label bigint")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == before or not now[0]:
            break
        before = now
        edges = staged(_stars(_stars(edges, True), False), "stars")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
