"""Operator 9: exact top-k search with a pivot-distance index.

Scores are inner products of whole-number vectors. With M the largest norm, a vector x
is lifted to (x, sqrt(M^2 - |x|^2)) and a query q to (q, 0); then |q - x|^2 =
|q|^2 + M^2 - 2 q.x, so a higher score is a smaller distance. Each vector is keyed by its
nearest pivot and the distance to it; the table is sorted by that key and cut into units
of a bounded number of rows, each a stretch of annuli.

A query first searches the unit that it lies in, where the nearest annuli are. Its k-th
best score there and the triangle inequality say which other units can hold a better one:
queries that lie side by side form a block, and blocks meet the units they reach in a join
on the pivot and a bin of the distance. A unit is held by one task, queries stream past it, and each visits its
annuli outwards until no farther one can hold a score above its k-th best. What is visited
is scored exactly, in whole numbers. The driver holds the pivots and nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, shuffle_partitions, staged, table, with_row

PIVOTS = 64
SAMPLE = 2048  # rows that pivots are chosen from; every row is indexed
UNIT = 65_536  # rows of the index that a task holds
QUERY_BLOCK = 256  # queries that are sent to a unit together
STEP = 2048  # queries that are searched at once
BINS = 128  # of distance, in which blocks of queries meet units
ANNULUS = 512  # rows of the sorted index that are scored together
EXACT = float(1 << 53)
LARGEST = float(1 << 62)  # of a score


def whole_vectors(vectors: DataFrame, column: str, scale: int) -> DataFrame:
    """Rows that take part: id not null, no null or non-finite component. The components
    are floor(scale * x). Vectors of different lengths count as filled up with zeros."""
    x = F.col("x")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = with_row(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(f"`{column}`").alias("x"))).withColumn("good", F.coalesce(good, F.lit(False)))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.pow(v.cast("double") * scale, 2))
    return rows.filter("good").select(ROW, "vec_id", F.transform("x", lambda v: F.floor(v.cast("double") * scale).cast("bigint")).alias("v"), square.alias("square"))


def _matrix(column, width: int | None = None) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = width if width is not None else int(lengths.max(initial=0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, places] = flat
    return out


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products as whole numbers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if bound < EXACT:
        return np.rint(queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    return queries @ vectors.T


def _lifted(vectors: np.ndarray, norm2: float) -> np.ndarray:
    own = (vectors.astype(float) ** 2).sum(1)
    return np.hstack([vectors.astype(float), np.sqrt(np.maximum(norm2 - own, 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Farthest-first: each pivot is the sample row farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(PIVOTS, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _keyed(shipped):
    def run(batches):
        pivots, norm2, width = shipped.value
        for batch in batches:
            if batch.num_rows:
                d = _distances(_lifted(_matrix(batch.column(2), width), norm2), pivots)
                nearest = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])], names=[*batch.schema.names, "pivot", "distance"])

    return run


class _Best:
    """The k best of each query so far: score descending, then id ascending."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score, self.vec, self.row = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def bound(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, which: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray, own: np.ndarray) -> None:
        bound = self.bound()[which]
        i, j = np.nonzero((score >= bound[:, None]) & (row[None, :] != own[which][:, None]))
        if not len(i):
            return
        q = which[i]
        touched, place = np.unique(q, return_inverse=True)
        n = len(touched)
        all_q = np.concatenate([np.repeat(np.arange(n), self.k), place])
        all_s = np.concatenate([self.score[touched].ravel(), score[i, j]])
        all_v = np.concatenate([self.vec[touched].ravel(), vec[j]])
        all_r = np.concatenate([self.row[touched].ravel(), row[j]])
        order = np.lexsort([all_r, all_v, -all_s.astype(float), all_q]) if np.abs(all_s).max() < EXACT else np.lexsort([all_r, all_v, ~all_s, all_q])
        first = np.searchsorted(all_q[order], np.arange(n))
        take = order[(first[:, None] + np.arange(self.k)).ravel()].reshape(n, self.k)
        self.score[touched], self.vec[touched], self.row[touched] = all_s[take], all_v[take], all_r[take]


class _Unit:
    """A stretch of the sorted index: annuli around one or a few pivots."""

    def __init__(self, shipped, batches: list):
        self.pivots, self.norm2, self.width, self.k = shipped
        table = pa.Table.from_batches(batches).combine_chunks()
        self.row, self.vec, self.pivot, self.distance = (table.column(c).to_numpy() for c in (ROW, "vec_id", "pivot", "distance"))
        self.vectors = np.vstack([_matrix(c, self.width) for c in table.column("v").chunks])
        cuts = np.flatnonzero(np.diff(self.pivot)) + 1
        self.annuli = [(a + i, min(a + i + ANNULUS, b)) for a, b in zip([0, *cuts], [*cuts, len(self.vec)], strict=True) for i in range(0, b - a, ANNULUS)]
        self.low, self.high, self.of = (np.array(x) for x in zip(*[(self.distance[a], self.distance[b - 1], self.pivot[a]) for a, b in self.annuli], strict=True))

    def reach(self, queries: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Distances beyond which a query has no score above its bound."""
        size2 = (queries.astype(float) ** 2).sum(1)
        return np.sqrt(np.maximum(self.norm2 + size2 - 2 * np.maximum(bound.astype(float), -LARGEST), 0)) + 1e-6 * (1 + np.sqrt(self.norm2 + size2.max(initial=0)))

    def to_pivots(self, queries: np.ndarray) -> np.ndarray:
        return _distances(np.hstack([queries.astype(float), np.zeros((len(queries), 1))]), self.pivots)

    def search(self, queries: np.ndarray, rows: np.ndarray, floor: np.ndarray) -> _Best:
        best, to_pivot = _Best(len(queries), self.k, floor), self.to_pivots(queries)[:, self.of]
        # least distance from a query to anything in an annulus, by the triangle inequality
        gap = np.maximum(np.maximum(self.low[None, :] - to_pivot, to_pivot - self.high[None, :]), 0)
        for step in np.argsort(gap.min(0), kind="stable"):
            which = np.flatnonzero(gap[:, step] <= self.reach(queries, best.bound()))
            if len(which):
                a, b = self.annuli[step]
                best.add(which, scores(queries[which], self.vectors[a:b]), self.vec[a:b], self.row[a:b], rows)
        return best


FOUND = "query_id bigint, query_row bigint, vec_id bigint, score bigint, row bigint"
LOWEST = np.iinfo(np.int64).min


def _hits(ids: np.ndarray, rows: np.ndarray, best: _Best) -> pa.RecordBatch:
    q, r = np.nonzero(best.row >= 0)
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(rows[q]), pa.array(best.vec[q, r]), pa.array(best.score[q, r]), pa.array(best.row[q, r])], names=["query_id", "query_row", "vec_id", "score", "row"])


def _at_home(shipped, every: int):
    """Each partition is a unit. Its rows with their unit and, for queries, their block and
    what they found in the unit."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        own, unit = _Unit(shipped.value, batches), TaskContext.get().partitionId()
        asked = np.flatnonzero(own.vec % every == 0)
        block, floor, found = np.full(len(own.vec), -1), np.full(len(own.vec), LOWEST), [None] * len(own.vec)
        block[asked] = (unit << 32) + np.arange(len(asked)) // QUERY_BLOCK
        for at in range(0, len(asked), STEP):
            which = asked[at : at + STEP]
            best = own.search(own.vectors[which], own.row[which], np.full(len(which), LOWEST))
            floor[which] = best.score[:, -1]
            for i, v, s, r in zip(which.tolist(), best.vec.tolist(), best.score.tolist(), best.row.tolist(), strict=True):
                found[i] = [{"vec_id": a, "score": b, "row": c} for a, b, c in zip(v, s, r, strict=True) if c >= 0]
        at, kind = 0, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64()), ("row", pa.int64())]))
        for b in batches:
            part = slice(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, unit, np.int64)), pa.array(block[part]), pa.array(floor[part]), pa.array(found[part], kind)], names=[*b.schema.names, "unit", "block", "floor", "found"])

    return run


def _spans(shipped):
    """For each query and pivot: block, pivot, distance and reach."""

    def run(batches):
        pivots, norm2, width, _ = shipped.value
        for batch in batches:
            if batch.num_rows:
                queries, n = _matrix(batch.column(1), width), len(pivots)
                floor = batch.column(2).to_numpy().astype(float)
                d = _distances(np.hstack([queries.astype(float), np.zeros((len(queries), 1))]), pivots)
                size2 = (queries.astype(float) ** 2).sum(1)
                reach = np.sqrt(np.maximum(norm2 + size2 - 2 * np.maximum(floor, -LARGEST), 0)) + 1e-6 * (1 + np.sqrt(norm2 + size2))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(queries))), pa.array(d.ravel()), pa.array(np.repeat(reach, n))], names=["block", "pivot", "d", "reach"])

    return run


def _visited(shipped):
    """Rows come sorted by unit, those of the index first (query false): each unit is
    built once and the queries that reach it stream past."""

    def run(batches):
        unit, stored, own = None, [], None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                units, query = batch.column(0).to_numpy()[at:], batch.column(1).to_numpy(zero_copy_only=False)[at:]
                same = (units == units[0]) & (query == query[0])
                n = int(same.argmin()) if not same.all() else len(same)
                part = batch.slice(at, n)
                at += n
                if units[0] != unit:
                    unit, stored, own = units[0], [], None
                if not query[0]:
                    stored.append(part)
                    continue
                own = own or (_Unit(shipped.value, stored) if stored else None)
                for i in range(0, n if own else 0, STEP):
                    piece = part.slice(i, STEP)
                    rows = piece.column(2).to_numpy()
                    yield _hits(piece.column(3).to_numpy(), rows, own.search(_matrix(piece.column(4), own.width), rows, piece.column(7).to_numpy()))

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, column: str = "embedding", scale: int = 256) -> DataFrame:
    """For each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score of
    its k best other rows, ties to the smaller vec_id; exact.

    Rows with a null id or a vector that is null or has null or non-finite components take
    no part; an empty vector counts as zeros. Numbers so large that scores may not fit 64
    bits are an error, nothing is dropped for its size. Rows that repeat a vec_id are rows
    of their own, as queries and as candidates. Fewer candidates than k give fewer rows;
    empty tables give none. Extra columns are ignored, whatever their names."""
    spark = vectors.sparkSession
    rows = staged(whole_vectors(vectors, column, scale), "vectors")
    norm2, width, total = rows.agg(F.max("square"), F.max(F.size("v")), F.count("*")).first()
    if (norm2 or 0) >= LARGEST:
        raise ValueError(f"components are too large for scores of 64 bits: a vector has the squared norm {norm2:g}")
    norm2, width = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0] or 0.0, int(width or 0)
    sample = rows.orderBy(F.xxhash64("vec_id", ROW)).limit(SAMPLE).select("v").toArrow().combine_chunks()  # bounded
    known = _matrix(sample.column("v").combine_chunks(), width) if sample.num_rows else np.zeros((0, width), np.int64)
    pivots = choose_pivots(_lifted(known, norm2))
    shipped = spark.sparkContext.broadcast((pivots, norm2, width))
    schema = f"{ROW} bigint, vec_id bigint, v array<bigint>, pivot int, distance double"
    keyed = rows.select(ROW, "vec_id", "v").mapInArrow(_keyed(shipped), schema)
    units = max(min(shuffle_partitions(spark), total), -(-total // UNIT), 1)
    ordered = keyed.repartitionByRange(units, "pivot", "distance", "vec_id", ROW).sortWithinPartitions("pivot", "distance", "vec_id", ROW)
    shipped = spark.sparkContext.broadcast((pivots, norm2, width, k))
    index = staged(ordered.mapInArrow(_at_home(shipped, every), schema + ", unit bigint, block bigint, floor bigint, found array<struct<vec_id:bigint,score:bigint,row:bigint>>"), "index")
    asked = index.filter("block >= 0")
    reach = asked.select("block", "v", "floor").mapInArrow(_spans(shipped), "block bigint, pivot int, d double, reach double").groupBy("block", "pivot").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.max("reach").alias("reach"))
    directory = index.groupBy("unit", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
    gap = F.greatest(F.col("low") - F.col("far"), F.col("near") - F.col("high"))
    # stretches of distance meet in bins: a pivot alone would be one key for all its units and
    # blocks. A pair counts in the first bin that both have, so once.
    top = directory.agg(F.max("high")).first()[0] or 1.0
    bin_of = lambda d: F.floor(F.least(F.greatest(d, F.lit(0.0)), F.lit(top)) / F.lit(top / BINS)).cast("int")
    binned = lambda rows, first, last, name: rows.withColumn(name, bin_of(first)).withColumn("bin", F.explode(F.sequence(F.col(name), bin_of(last))))
    directory = binned(directory, F.col("low"), F.col("high"), "from_unit")
    reach = binned(reach.filter(F.col("near") - F.col("reach") <= top), F.col("near") - F.col("reach"), F.col("far") + F.col("reach"), "from_block")
    once = F.col("bin") == F.greatest("from_unit", "from_block")
    reached = reach.join(directory, ["pivot", "bin"]).filter(once & (gap <= F.col("reach"))).select("block", F.col("unit").alias("visit")).distinct()
    columns = [ROW, "vec_id", "v", "pivot", "distance", "floor"]
    sent = asked.join(reached, "block").filter("visit <> unit").select(F.col("visit").alias("unit"), F.lit(True).alias("query"), *columns)
    stored = index.select("unit", F.lit(False).alias("query"), *columns)
    visits = stored.unionByName(sent).repartitionById(units, F.col("unit").cast("int")).sortWithinPartitions("unit", "query", "pivot", "distance", "vec_id", ROW)
    found = visits.mapInArrow(_visited(shipped), FOUND).unionByName(asked.select(F.col("vec_id").alias("query_id"), F.col(ROW).alias("query_row"), F.inline("found")))
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS qr, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.x, b.x)]) AS BIGINT) AS score, b.r AS br FROM v AS a JOIN v AS b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, br) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM o WHERE rank <= 5
"""
