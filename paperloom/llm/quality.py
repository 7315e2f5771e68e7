"""Operator 7: document quality by co-training.

Two views of a document: what its text holds (words, marks, shape) and what its metadata
say (source, language, length). Each view has a logistic classifier over hashed features.
In each round both views score every document of the table that has no label in the fit,
and each gives the other the labels it is surest of: calibrated probability of SURE or
more (or 1 - SURE or less), at most the surest share TAKEN of those not given before. Both
are fitted again, with gradients summed over all pseudo-labelled documents. At last each
view is calibrated on labelled documents that were held out, and their log-odds are added,
the prior counted once.

The labelled rows of the fit are bounded (LABELLED, chosen by a hash of the id among the
documents that are there). Pseudo-labels, scores and thresholds cover the whole table;
they are gathered as sums and histograms of fixed size, and no document is left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .features import adam, chosen, letter_words, sigmoid

LABELLED = 5_000  # rows of the fit, the bound of the driver's share
ROUNDS, STEPS = 3, 6  # exchanges, and passes over all pseudo-labels after each
TAKEN, SURE = 0.1, 0.95
WIDTHS = (1 << 15, 1 << 12)  # hashed features of the text view and of the metadata view
BLOCK = 1024  # features whose sums travel in one row
BINS, EDGE = 4096, 16.0  # of the histogram of log-odds
FIXED_POINT = 1 << 24  # sums are whole numbers: the order of tasks does not matter
L2 = 1e-4
KEPT = 0.5  # probability of good quality from which a document is kept

_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")


def _level(share: float) -> int:
    return min(10, int(share * 10))


def text_view(text: str) -> set[bytes]:
    """Words, runs of marks, and the shape of a whole text as features."""
    raw = text.encode()
    tokens = raw.split()
    out = {b"w:" + w for w in letter_words(text)}
    marks, n = Counter(_MARKS.findall(raw)), max(1, len(tokens))
    out.update(b"m:%b:%d" % (m, _level(count / n)) for m, count in marks.items())
    lines = [x for x in raw.split(b"\n") if x]
    kinds = Counter(tokens)
    shape = {
        b"upper": sum(n for t, n in kinds.items() if t.isupper()) / n,
        b"kinds": len(kinds) / n,
        b"most": max(kinds.values(), default=0) / n,
        b"marks": sum(marks.values()) / n,
        b"lines": 1 - len(set(lines)) / max(1, len(lines)),
    }
    out.update(b"s:%b:%d" % (name, _level(share)) for name, share in shape.items())
    out.add(b"s:length:%d" % min(12, len(tokens).bit_length()))
    return out


def meta_view(source, lang, n_chars) -> set[bytes]:
    size = min(24, max(0, int(n_chars or 0)).bit_length())
    return {x.encode() for x in (f"source:{source}", f"lang:{lang}", f"size:{size}", f"{lang}:{size}")}


def hashed(features: set[bytes], width: int) -> bytes:
    """Sorted places of the features, as unsigned 16-bit numbers."""
    return np.unique(np.fromiter((zlib.crc32(f) % width for f in features), "<u2", len(features))).tobytes()


class Rows:
    """Documents as lists of places of features that they hold."""

    def __init__(self, packed: list[bytes], width: int):
        self.n, self.width = len(packed), width
        self.columns = np.frombuffer(b"".join(packed), "<u2").astype(np.int64)
        self.rows = np.repeat(np.arange(self.n), [len(x) // 2 for x in packed])

    def times(self, x: np.ndarray) -> np.ndarray:
        """Log-odds under weights and bias (the last value)."""
        return np.bincount(self.rows, x[self.columns], self.n) + x[-1]

    def gradient(self, errors: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.columns, errors[self.rows], self.width), errors.sum())


def fit(rows: Rows, y: np.ndarray) -> np.ndarray:
    return adam(lambda x: rows.gradient((sigmoid(rows.times(x)) - y) / max(1, len(y))) + L2 * np.append(x[:-1], 0), np.zeros(rows.width + 1), steps=100)


def calibrated(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling of log-odds on held-out rows, with the usual softened targets."""
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def gradient(x):
        error = (sigmoid(x[0] * s + x[1]) - goal) / max(1, len(y))
        return np.array([(error * s).sum() + 1e-3 * (x[0] - 1), error.sum()])

    slope, shift = adam(gradient, np.array([1.0, 0.0]), steps=200)
    return float(slope), float(shift)


def featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with both views as packed features (__pl_text,
    __pl_meta) and a hash of the text (__pl_hash), written to the shared folder: texts are
    read once."""
    names = [c for c in keep if c not in ("__pl_text", "__pl_meta", "__pl_hash")]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col("source").cast("string").alias("__pl_source"), F.col("lang").cast("string").alias("__pl_lang"), F.col("n_chars").cast("bigint").alias("__pl_n"), F.coalesce("text", F.lit("")).alias("__pl_text"), F.xxhash64("text").alias("__pl_hash"))
    schema = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(b"").alias("__pl_text"), F.lit(b"").alias("__pl_meta"), F.lit(0).cast("bigint").alias("__pl_hash")).schema
    wide, narrow = WIDTHS

    def run(batches):
        for batch in batches:
            source, lang, size, text = (batch.column(i) for i in range(len(names), len(names) + 4))
            of_text = [hashed(text_view(x.as_py()), wide) for x in text]
            of_meta = [hashed(meta_view(*x), narrow) for x in zip(source.to_pylist(), lang.to_pylist(), size.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(of_text, pa.binary()), pa.array(of_meta, pa.binary()), batch.columns[-1]], names=[*names, "__pl_text", "__pl_meta", "__pl_hash"])

    return staged(source.mapInArrow(run, schema), "quality-features")


def _given(views, rules: list) -> np.ndarray:
    """Labels that the rules of earlier rounds give (-1: none), the first one counts.
    views: rows of both views; rules: (giver, weights, least of 1, most of 0)."""
    out = np.full(views[0].n, -1)
    for giver, x, high, low in rules:
        s = views[giver].times(x)
        out = np.where(out >= 0, out, np.where(s >= high, 1, np.where(s < low, 0, -1)))
    return out


def _batches(batches, known: set):
    """Both views of the rows that have no label in the fit."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        free = [i for i, x in enumerate(ids) if x not in known]
        text, meta = (batch.column(i).take(pa.array(free, pa.int64())).to_pylist() for i in (1, 2))
        if free:
            yield (text, meta), (Rows(text, WIDTHS[0]), Rows(meta, WIDTHS[1]))


def _histograms(shipped):
    """For each giving view: how many documents not yet given have log-odds in each bin."""

    def run(batches):
        known, past, now = shipped.value
        counts = np.zeros((2, BINS), np.int64)
        for _, views in _batches(batches, known):
            for giver in (0, 1):
                s = views[giver].times(now[giver])[_given(views, past[1 - giver]) < 0]
                counts[giver] += np.bincount(np.clip((s + EDGE) * (BINS / (2 * EDGE)), 0, BINS - 1).astype(np.int64), minlength=BINS)
        giver, bin_ = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(giver.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(counts[giver, bin_])], names=["giver", "bin", "n"])

    return run


def _selected(shipped):
    """view, y and features of the documents that the rules of this round give to a view."""

    def run(batches):
        known, past, rules = shipped.value
        for packed, views in _batches(batches, known):
            for view in (0, 1):
                y = np.where(_given(views, past[view]) >= 0, -1, _given(views, rules[view]))
                hit = np.flatnonzero(y >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), view, np.int32)), pa.array(y[hit].astype(np.int32)), pa.array([packed[view][i] for i in hit], pa.binary())], names=["view", "y", "features"])

    return run


def _gradients(shipped):
    """Sums of a task over its pseudo-labelled documents: blocks of each view's gradient."""

    def run(batches):
        now = shipped.value
        sums = [np.zeros(w + 1) for w in WIDTHS]
        for batch in batches:
            which, y, n = (batch.column(i).to_numpy() for i in (0, 1, 3))
            for view in (0, 1):
                own = np.flatnonzero(which == view)
                if len(own):
                    rows = Rows(batch.column(2).take(pa.array(own)).to_pylist(), WIDTHS[view])
                    sums[view] += rows.gradient((sigmoid(rows.times(now[view])) - y[own]) * n[own])
        out = [(view, at, np.rint(part * FIXED_POINT).astype("<i8").tobytes()) for view in (0, 1) for at in range(0, WIDTHS[view] + 1, BLOCK) if (part := sums[view][at : at + BLOCK]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["view", "at", "sums"])

    return run


def _summed(batches):
    """One row for each block: the sum over all tasks."""
    total: dict = {}
    for batch in batches:
        for view, at, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(part, "<i8")
            total[view, at] = total[view, at] + part if (view, at) in total else part
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], names=["view", "at", "sums"])


def _cuts(counts: np.ndarray, slope: float, shift: float, share: float) -> tuple[float, float]:
    """Log-odds from which a view gives 1, and below which it gives 0: whole bins from the
    surest end, as long as they are sure and stay within the share TAKEN."""
    wanted, edges = TAKEN * counts.sum(), np.linspace(-EDGE, EDGE, BINS + 1)
    sure = sigmoid(slope * edges + shift)
    above, below = np.cumsum(counts[::-1])[::-1], np.cumsum(counts)
    good = np.flatnonzero((sure[:-1] >= SURE) & (above <= share * wanted))
    bad = np.flatnonzero((sure[1:] <= 1 - SURE) & (below <= (1 - share) * wanted))
    return (edges[good[0]] if slope > 0 and len(good) else math.inf), (edges[bad[-1] + 1] if slope > 0 and len(bad) else -math.inf)


def train(features: DataFrame, labels: DataFrame):
    """((weights, slope, shift) of the text view, the same of the metadata view, prior
    log-odds), from the result of featured() with a doc_id and labels (doc_id, quality).
    Without labels of both kinds every document gets probability 1/2. A doc_id that labels
    repeat takes its smallest label; one that docs repeat counts with one of its texts, and
    equal texts count once."""
    blank = tuple((np.zeros(w + 1), 1.0, 0.0) for w in WIDTHS)
    picked = chosen(features, labels, "quality", LABELLED)
    rows = features.select("doc_id", "__pl_text", "__pl_meta", "__pl_hash").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("__pl_hash", "__pl_text", "__pl_meta", "label")).alias("first"))
    rows = rows.select("first.__pl_hash", F.struct("doc_id", "first.*").alias("first")).groupBy("__pl_hash").agg(F.min("first").alias("first")).select("first.*")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    y = np.array(rows.column("label").to_pylist(), int)
    held = np.arange(len(y)) % 5 == 0
    base, goal = y[~held], y[held]
    if len(y) < 10 or base.min() == base.max():
        return (*blank, 0.0)
    spark, share = features.sparkSession, float(base.mean())
    known = {r[0] for r in picked.select("doc_id").collect()}
    own, test = [], []
    for view, name in enumerate(("__pl_text", "__pl_meta")):
        packed = rows.column(name).to_pylist()
        own.append(Rows([x for x, h in zip(packed, held, strict=True) if not h], WIDTHS[view]))
        test.append(Rows([x for x, h in zip(packed, held, strict=True) if h], WIDTHS[view]))
    now = [fit(own[v], base) for v in (0, 1)]
    all_rows, past, pseudo = features.select("doc_id", "__pl_text", "__pl_meta"), ([], []), None
    for _ in range(ROUNDS):
        shipped = spark.sparkContext.broadcast((known, past, now))
        counts = np.zeros((2, BINS), np.int64)
        for r in all_rows.mapInArrow(_histograms(shipped), "giver int, bin int, n bigint").groupBy("giver", "bin").agg(F.sum("n").alias("n")).collect():  # at most 2 x BINS rows
            counts[r.giver, r.bin] = r.n
        rules = ([], [])
        for giver in (0, 1):
            high, low = _cuts(counts[giver], *calibrated(test[giver].times(now[giver]), goal), share)
            if (high, low) != (math.inf, -math.inf):
                rules[1 - giver].append((giver, now[giver], high, low))
        if not any(rules):
            break
        shipped = spark.sparkContext.broadcast((known, past, rules))
        fresh = all_rows.mapInArrow(_selected(shipped), "view int, y int, features binary")
        fresh = staged(fresh.groupBy("view", "y", "features").agg(F.count("*").alias("n")), "quality-pseudo")
        pseudo = fresh if pseudo is None else pseudo.unionByName(fresh)
        totals = np.zeros(2)
        for r in pseudo.groupBy("view").agg(F.sum("n").alias("n")).collect():
            totals[r.view] = r.n
        past = tuple(past[v] + rules[v] for v in (0, 1))
        now = _refitted(pseudo, totals, own, base, now)
    parts = [(now[v], *calibrated(test[v].times(now[v]), goal)) for v in (0, 1)]
    return (*parts, math.log(share / (1 - share)))


def _refitted(pseudo: DataFrame, totals: np.ndarray, own: list[Rows], base: np.ndarray, start: list[np.ndarray]) -> list[np.ndarray]:
    """A few steps on the mean loss of the labelled rows plus that of all pseudo-labelled
    ones; the second gradient is summed over the table in each step."""
    spark = pseudo.sparkSession

    def gradient(flat):
        now = np.split(flat, [WIDTHS[0] + 1])
        shipped = spark.sparkContext.broadcast(now)
        parts = pseudo.select("view", "y", "features", "n").mapInArrow(_gradients(shipped), "view int, at int, sums binary")
        sums = parts.repartition("view", "at").mapInArrow(_summed, "view int, at int, sums binary").collect()  # as long as the models
        shipped.unpersist()
        out = []
        for v in (0, 1):
            g = own[v].gradient((sigmoid(own[v].times(now[v])) - base) / len(base)) + L2 * np.append(now[v][:-1], 0)
            for r in sums:
                if r.view == v:
                    part = np.frombuffer(bytes(r.sums), "<i8")
                    g[r.at : r.at + len(part)] += part / (FIXED_POINT * totals[v])
            out.append(g)
        return np.concatenate(out)

    return np.split(adam(gradient, np.concatenate(start), steps=STEPS, rate=0.05, least=1e-6), [WIDTHS[0] + 1])


def scored(features: DataFrame, model, keep: list[str]) -> DataFrame:
    """The columns `keep` of featured() with p_text, p_meta (calibrated views), quality
    (both combined) and good (quality of KEPT or more)."""
    results = ["p_text", "p_meta", "quality", "good"]
    names = [c for c in keep if c not in results]
    shipped = features.sparkSession.sparkContext.broadcast(model)
    schema = features.select(*[F.col(f"`{c}`") for c in names], F.lit(0.0).alias("p_text"), F.lit(0.0).alias("p_meta"), F.lit(0.0).alias("quality"), F.lit(True).alias("good")).schema

    def run(batches):
        *views, prior = shipped.value
        for batch in batches:
            s, t = (slope * Rows(batch.column(len(names) + v).to_pylist(), WIDTHS[v]).times(x) + shift for v, (x, slope, shift) in enumerate(views))
            q = sigmoid(s + t - prior)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sigmoid(s)), pa.array(sigmoid(t)), pa.array(q), pa.array(q >= KEPT)], names=[*names, *results])

    return features.select(*[F.col(f"`{c}`") for c in names], "__pl_text", "__pl_meta").mapInArrow(run, schema)


def graded(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Fits on labels (doc_id, quality) and scores every row of docs (doc_id, text, source,
    lang, n_chars): the columns `keep` with p_text, p_meta, quality and good.

    Null and empty texts have no words but a shape; null metadata are values of their own.
    Texts of any length are read whole. Every row is returned once, rows that repeat a
    doc_id each by its own text; a null doc_id has no label. Ties of probability are all
    given or not given together. An empty table gives an empty result. Of extra columns
    those in `keep` stay; columns named as results are replaced."""
    features = featured(docs, list(dict.fromkeys(["doc_id", *keep])))
    return scored(features, train(features, labels), keep)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
