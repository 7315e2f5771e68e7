"""What the operators share: the shared folder, staged tables and small tokenisers."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "__pl_row"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local
    master (one machine, as in tests) gets a new temporary one; on a cluster executors
    could not read each other's files in such a folder, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: the lineage
    ends there and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Documents in so few files that less than half of the cores
    would work are dealt out; larger ones stay as they are split."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if name == "documents" and 2 * scan.rdd.getNumPartitions() <= cores else scan


def with_row(df: DataFrame) -> DataFrame:
    """A number for each row, for tables whose ids may repeat or be null. It is
    a function of the partition and the place in it, so a retried task gives
    the same numbers. Results that use it twice must be staged first."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_filter(hashes: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """A filter of the values of a column of 64-bit hashes: words of 64 bits, and the mask of
    places. It grows with the number of rows, to at most 2 ** most bits, and is summed
    before it reaches the driver. It only spares work: what passes by chance is found out
    by the join that follows."""
    column = F.col(hashes.columns[0])
    bits = min(most, max(16, int(16 * hashes.count()).bit_length()))
    place = column.bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()  # at most 2 ** (most - 6) rows
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out, (1 << bits) - 1


def passes(shipped: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the filter."""
    words, mask = shipped
    place = hashes.view(np.uint64) & np.uint64(mask)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def worker_state(key, make):
    """An object that a Python worker makes once and keeps for later tasks: a vocabulary,
    a memo. Only the one used last is kept, so that the stages of a pipeline don't add up."""
    kept = sys.modules.setdefault("_paperloom_worker", types.ModuleType("_paperloom_worker")).__dict__
    if kept.get("state", (None,))[0] != key:
        kept["state"] = (None,)
        kept["state"] = (key, make())
    return kept["state"][1]


PART, BEFORE = "__pl_part", "__pl_before"


def prefix_sums(rows: DataFrame, group: list[str], order: list, value: Column, per_group: DataFrame | None = None) -> DataFrame:
    """rows (staged or cheap: they are read twice) with BEFORE, the sum of `value` over the
    rows of their group that come earlier by `order`; a group with a third of all rows is no
    hot spot. Rows are dealt out by ranges of (group, order); each range sums its own, and
    sums of ranges, a table as long as ranges and groups, are carried over. per_group (its
    columns: the group, and more) joins that small table, so that no row meets a hot key.
    Rows that tie in `order` must be alike in it and in `value`; null groups are dropped."""
    ranged = staged(rows.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id()), "ranged")
    sums = staged(ranged.groupBy(PART, *group).agg(F.sum(value).alias("__pl_sum")), "sums")
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__pl_offset", F.coalesce(F.sum("__pl_sum").over(earlier), F.lit(0))).drop("__pl_sum")
    if per_group is not None:
        offsets = offsets.join(per_group, group)
    parts = 1 + (sums.agg(F.max(PART)).first()[0] or 0)
    inside = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.repartitionById(parts, F.col(PART)).withColumn(BEFORE, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(offsets, [PART, *group]).withColumn(BEFORE, F.col(BEFORE) + F.col("__pl_offset")).drop(PART, "__pl_offset")
