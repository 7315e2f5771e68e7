"""Sparse text features and a solver for models on them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def letter_words(text: str) -> list[bytes]:
    """Lower-cased runs of letters (and of any signs outside ASCII)."""
    return text.lower().encode().translate(_LETTERS).split()


class Rows:
    """Sparse rows: for each the places of its features and their values."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray], width: int):
        self.n, self.width = len(columns), width
        self.columns, self.values = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((columns, np.int64), (values, float)))
        self.rows = np.repeat(np.arange(self.n), [len(x) for x in columns])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns] * self.values, self.n)

    def gradient(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, errors[self.rows] * self.values, self.width)


def associated(rows: DataFrame, bag, least: int = 5, chi2: float = 30.0, most: int = 20_000) -> dict:
    """The features of at least `least` rows (text, label) that are commoner where the label
    is 1, by a chi-square statistic of at least `chi2`; at most `most`, the strongest first,
    numbered. They are counted where the rows are; bag(text) gives the features of a text."""

    def counted(batches):
        df, hit, n, ones = Counter(), Counter(), 0, 0
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = bag(text.as_py()).keys()
                df.update(found)
                n, ones = n + 1, ones + label
                if label:
                    hit.update(found)
        yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.binary()), pa.array([n, *df.values()], pa.int64()), pa.array([ones, *[hit[f] for f in df]], pa.int64())], names=["feature", "d", "h"])

    sums = rows.select("text", "label").mapInArrow(counted, "feature binary, d bigint, h bigint").groupBy("feature").agg(F.sum("d").alias("d"), F.sum("h").alias("h"))
    sums = staged(sums, "associated")
    n, ones = sums.filter("feature is null").select("d", "h").first() or (0, 0)
    d, h = F.col("d").cast("double"), F.col("h").cast("double")
    x = (h - d * ones / max(1, n)) ** 2 * float(n) ** 3 / F.greatest(F.lit(1e-9), float(ones) * (n - ones) * d * (n - d))
    found = sums.filter(F.col("feature").isNotNull() & (d >= least) & (d < n) & (h * max(1, n) > d * ones)).withColumn("x", x).filter(F.col("x") >= chi2)
    return {bytes(r.feature): i for i, r in enumerate(found.orderBy(F.desc("x"), "feature").limit(most).collect())}  # the size of the model


def adam(gradient, x: np.ndarray, steps: int = 150, rate: float = 0.1, positive: int = 0, least: float = 1e-8) -> np.ndarray:
    """Plain full-batch descent; deterministic. The first `positive` values stay 0 or more;
    slopes far under `least` move nothing."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.95 * v + 0.05 * g * g
        x = x - rate * (1 - t / (steps + 1)) ** 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.95**t)) + least)
        np.maximum(x[:positive], 0, out=x[:positive])
    return x


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def chosen(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """doc_id and label of at most `bound` documents that labels and docs both hold, by a
    hash of the id: the same for any order of rows. Only ids move. A doc_id that labels
    repeat takes its smallest label."""
    there = docs.select("doc_id").filter("doc_id is not null").distinct()
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(F.col(column).cast("int")).alias("label"))
    return staged(known.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "chosen")  # a documented bound of the fit


def sampled(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """doc_id, text and label of the chosen() documents with a text, in the shared folder.
    Of rows that repeat a doc_id one counts; equal texts count once, with the smallest label."""
    full = docs.filter(F.col("text") != "").select("doc_id", "text")
    rows = full.join(F.broadcast(chosen(full, labels, column, bound)), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("first"))
    return staged(rows.select("first.text", F.struct("first.label", "doc_id").alias("first")).groupBy("text").agg(F.min("first").alias("first")).select("text", "first.*"), "sampled")
