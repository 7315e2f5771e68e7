"""Operator 10: toxicity grades by cumulative-link ordinal regression.

P(grade > j) = sigmoid(w.x - theta_j) with one weight vector for all ordered thresholds;
x holds log2(1 + count) of each word of the text, summed over words for the features they
share (stems), and the expected severity is the sum of these probabilities. Labels only say toxic or not; grades are derived from them: 0 for
texts that are not toxic; toxic texts are graded 1 to 3 by the score of a first,
binary fit (terciles; texts without any feature are graded 1). Only
features tied to toxic labels take part and weights are not negative, so that no number
of harmless words outweighs an insult.

The model is fitted on a bounded number of labelled rows (LABELLED, chosen by a hash of
the id, whole texts). Their features are counted in tasks; the driver gets the selected
ones alone. Every row of the table is scored over its whole text.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, worker_state
from .features import Rows, adam, associated, letter_words, sampled, sigmoid

GRADES = 4
LABELLED = 12_000
L2 = 2e-4
STEMS = (4, 5, 6)
REJECTED = 0.5  # expected severity from which a text is toxic


def parts(word: bytes) -> list[bytes]:
    """The features of a word: itself and, for longer ones, its stem (first signs)."""
    return [word, *[word[:n] + b"*" for n in STEMS if len(word) > n]]


def bag(text: str) -> dict[bytes, float]:
    out: dict[bytes, float] = {}
    for w, n in Counter(letter_words(text)).items():
        value = math.log2(1 + n)
        for f in parts(w):
            out[f] = out.get(f, 0.0) + value
    return out


def fit_binary(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic fit; both classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def gradient(x):
        error = (sigmoid(rows.times(x[:-1]) + x[-1]) - y) * weight
        return np.concatenate([rows.gradient(error) + L2 * x[:-1], [error.sum()]])

    return adam(gradient, np.zeros(rows.width + 1), positive=rows.width)


def fit_ordinal(rows: Rows, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of the cumulative-link model, by maximum
    likelihood; thresholds are a first value and positive steps."""
    k, n = GRADES, max(1, rows.n)
    share = np.clip([(grade > j).mean() if len(grade) else 0.5 for j in range(k - 1)], 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(start), 1e-2))
    balance = np.where(grade > 0, 2.0, 1.0) / n

    def thresholds(x):
        return np.cumsum(np.concatenate([x[:1], np.exp(x[1:])]))

    def gradient(x):
        w, theta = x[: rows.width], thresholds(x[rows.width :])
        s = rows.times(w)
        cumulative = np.hstack([np.ones((rows.n, 1)), sigmoid(s[:, None] - theta[None, :]), np.zeros((rows.n, 1))])
        slope = cumulative * (1 - cumulative)
        at = np.arange(rows.n)
        p = np.maximum(cumulative[at, grade] - cumulative[at, grade + 1], 1e-12)
        upper, lower = slope[at, grade] / p * balance, slope[at, grade + 1] / p * balance
        by_theta = np.zeros(k + 1)
        np.add.at(by_theta, grade, upper)
        np.add.at(by_theta, grade + 1, -lower)
        g = by_theta[1:k]  # of -log likelihood
        by_step = np.array([g[j:].sum() for j in range(k - 1)])
        by_step[1:] *= np.exp(x[rows.width + 1 :])
        return np.concatenate([rows.gradient(lower - upper) + L2 * w, by_step])

    x = adam(gradient, np.concatenate([np.zeros(rows.width), start[:1], steps]), positive=rows.width)
    return x[: rows.width], thresholds(x[rows.width :])


class _WordWeights(dict):
    """Word to the sum of the weights of its features, remembered up to a bound."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        value = sum(self.weights.get(f, 0.0) for f in parts(word))
        if len(self) < 200_000:
            self[word] = value
        return value


class Model:
    def __init__(self, weights: dict[bytes, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def scorer(self):
        """A function from a text to w.x."""
        words, log2 = _WordWeights(self.weights), math.log2
        return lambda text: sum(v if n == 1 else v * log2(1 + n) for w, n in Counter(letter_words(text)).items() if (v := words[w]))


def _sparse(rows: DataFrame, vocabulary: dict) -> tuple[Rows, np.ndarray]:
    """What the texts of rows (doc_id, text, label) hold of a vocabulary, and the labels."""
    shipped = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shipped.value
        for batch in batches:
            found = [[(known[f], v) for f, v in bag(t.as_py()).items() if f in known] for t in batch.column(1)]
            columns, values = ([np.array([x[i] for x in row], t).tobytes() for row in found] for i, t in ((0, "<i8"), (1, "<f8")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(columns, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "label", "columns", "values"])

    found = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "label").mapInArrow(run, "doc_id bigint, label int, columns binary, values binary")
    table = found.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()  # at most LABELLED rows of selected features
    columns, values = ([np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("columns", "<i8"), ("values", "<f8")))
    return Rows(columns, values, len(vocabulary)), np.array(table.column("label").to_pylist(), int)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on docs (doc_id, text) and labels (doc_id, toxic). Without labelled rows of both
    kinds, all texts get severity 0. Texts that are null or empty take no part; see
    sampled() for repeats."""
    rows = sampled(docs, labels, "toxic", LABELLED)
    kinds = rows.agg(F.min("label"), F.max("label")).first()
    if kinds[0] == kinds[1]:
        return Model({}, np.full(GRADES - 1, np.inf))
    vocabulary = associated(rows, bag)
    sparse, toxic = _sparse(rows, vocabulary)
    first = fit_binary(sparse, toxic)
    amount = sparse.times(first[:-1])
    hit = (toxic == 1) & (amount > 0)
    cuts = np.quantile(amount[hit], [1 / 3, 2 / 3]) if hit.any() else np.zeros(2)
    grade = np.where(toxic == 1, 1 + np.where(hit, (amount[:, None] > cuts[None, :]).sum(1), 0), 0)
    w, thresholds = fit_ordinal(sparse, grade)
    return Model({f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 1e-4}, thresholds)


def _shipped(docs: DataFrame, model: Model):
    """The model as plain values: workers need not know its class."""
    return docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))


def _scored(shipped, names: list[str]):
    def run(batches):
        model = Model(*shipped.value)
        score = worker_state(("toxicity", sum(model.weights.values()), float(model.thresholds[0])), model.scorer)
        for batch in batches:
            s = np.array([score(t.as_py()) for t in batch.column(batch.num_columns - 1)])
            over = sigmoid(np.clip(s[:, None] - model.thresholds[None, :], -500, 500)) if len(s) else np.zeros((0, GRADES - 1))
            severity = over.sum(1)
            p = -np.diff(np.hstack([np.ones((len(s), 1)), over, np.zeros((len(s), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(severity), pa.array(p.argmax(1).astype(np.int32)), pa.array(severity >= REJECTED)], names=[*names, "severity", "grade", "toxic"])

    return run


def score_toxicity(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with severity (expected grade, 0 to 3), grade (the
    likeliest) and toxic (severity of REJECTED or more). Null and empty texts get what
    the thresholds alone give; texts of any length are read whole. Every row is returned
    once, rows that repeat a doc_id each by its own text. Columns named as results are
    replaced, other extra columns stay if they are in `keep`. An empty table gives an
    empty result."""
    keep = [c for c in keep if c not in {"severity", "grade", "toxic"}]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("__pl_text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(True).alias("toxic")).schema
    return source.mapInArrow(_scored(_shipped(docs, model), keep), schema)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that are toxic, row by row; all other rows and all columns
    stay, whatever the columns are named. Null and empty texts stay."""
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("text", F.lit("")).alias("__pl_text"))
    shipped, names = _shipped(docs, model), docs.columns

    def run(batches):
        for batch in _scored(shipped, [f"c{i}" for i in range(len(names))])(batches):
            kept = pc.invert(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(batch.columns[:-3], names=names).filter(kept)

    return source.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, ["doc_id"])
