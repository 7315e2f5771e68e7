"""A pipeline from raw documents to token ids. Each stage reads what the one before wrote.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of documents. They decide row by row: a row is never lost because another one has
its doc_id, or because its doc_id is null. Null and empty texts pass all filters but that
of exact repeats. Texts of any length are read whole, extra columns stay, whatever they are
named, and empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import contamination, neardup, pieces, pii, toxicity
from paperloom.llm.common import staged, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model is fitted on labelled rows of the input, at most
    toxicity.LABELLED. Without labels of both kinds all rows stay. Rows that repeat an id
    or a text are judged one by one, and equal texts alike."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id.
    Rows that share it keep one of each group of like texts; rows with a null doc_id all
    stay, and so do null and empty texts, but for exact repeats of id and text."""
    return neardup.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, by their own text. Without benchmark
    rows, or with items that have no words, nothing goes."""
    return contamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; every row stays. n_chars follows where it
    was right, and stays as it is where it was null or wrong. A null text stays null."""
    length = F.length("text").cast("bigint")
    marked = pii.redacted(docs.withColumn("__pl_right", F.col("n_chars") == length))
    return marked.withColumn("n_chars", F.when(F.col("__pl_right"), length.cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a hash of what they decode to; every row stays. Null and
    empty texts get the begin and end ids."""
    found = pieces.encode_decode(docs.select("doc_id", "text"), pieces.model_bytes(), keep_ids=True)
    return found.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("sentencepiece", encode),
]

#: A trained model, a similarity join and a tokenizer: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
