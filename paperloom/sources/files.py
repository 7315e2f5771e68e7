"""Documents in files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import dialect


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown_files(spark: SparkSession, path: str, source: str = "auto") -> DataFrame:
    """name, path, source, text, valid, error of Markdown files: bytes are decoded strictly,
    what is not UTF-8 stays as an invalid row."""
    raw = spark.read.format("binaryFile").load(path).filter(dialect.is_markdown_path(F.col("path")))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select(dialect.document_name(F.col("path")).alias("name"), "path", F.lit(source).alias("source"), text.alias("text"), good.alias("valid"), F.when(~good, "cannot read UTF-8 Markdown").alias("error"))


def packages(spark: SparkSession, path: str) -> DataFrame:
    """path, docx of Word packages in files."""
    return spark.read.format("binaryFile").load(path).filter(F.lower("path").endswith(".docx")).select("path", F.col("content").alias("docx"))


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over all cores, where its files give work to less than half of them
    (a small table in one row group). Larger tables are left as they are split."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan
