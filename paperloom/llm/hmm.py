"""Operator 1: language-model scores from a hidden Markov model.

Tokens are the words of the lower-cased text and one end sign. The model emits
*classes*: each of the most frequent training tokens is a class of its own, all
others fall into a fixed number of hash classes, and inside a hash class a word
has its smoothed share of the class, (c + 0.5) / (n + 0.5 * (v + 1)), with one
place for all unseen words. So the size of the model is fixed while the word
counts cover the whole corpus, and the probabilities of all words add up to 1.

Training is Baum-Welch over whole documents: each task adds up expected counts of
its documents (scaled forward and backward recursions), the counts are summed over
all tasks by a shuffle on the class, and the driver holds only the fixed-size
result. It starts from the shares of the classes in the whole corpus, shaken by a fixed
seed, with states that tend to stay; no document is singled out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, shuffle_partitions, staged, table, text_bytes, with_row, worker_state

TOP = 4096  # tokens with a class of their own
HASHED = 1024  # hash classes for all others
STATES = 8
ROUNDS = 4  # passes of Baum-Welch over the corpus
STAY = 0.98  # of a state, at the start
FIXED_POINT = 1 << 20  # expected counts are summed as whole numbers: the order of tasks does not matter
BLOCK_TOKENS = 300_000  # held in memory at once by the recursions
FLUSH_WORDS = 200_000
SLICE_WORDS, SLICES = 250_000, 32  # words of the vocabulary that a lookup task holds; least number of slices
END = b""  # no word is empty


def hash_class(word: bytes) -> int:
    return TOP + zlib.crc32(word) % HASHED


class Classes(dict):
    """Word to class; words that are not among the top ones are remembered up to a bound."""

    def __init__(self, top: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(top))
        self.top = set(top)

    def __missing__(self, word: bytes) -> int:
        c = hash_class(word)
        if len(self) < 200_000:
            self[word] = c
        return c


class Model:
    """start (K), move (K x K), emit (classes x K): probabilities."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def new(cls, freq: np.ndarray, seed: int = 7) -> Model:
        emit = freq[:, None] * np.exp(np.random.default_rng(seed).normal(0, 1, (len(freq), STATES)))
        move = np.full((STATES, STATES), (1 - STAY) / STATES) + np.eye(STATES) * STAY
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @classmethod
    def from_counts(cls, start, move, emit, freq) -> Model:
        """Expected counts, smoothed towards the corpus-wide class shares."""
        emit = emit + 10 * freq[:, None]
        move, start = move + 0.1, start + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def pieces_of(batches, rows: int):
    """The batches in pieces of at most so many rows: what a task holds beside them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks(docs: list[np.ndarray]):
    """Indices of documents, longest first, in blocks of a bounded number of tokens."""
    order, block, total = sorted(range(len(docs)), key=lambda i: -len(docs[i])), [], 0
    for i in order:
        if block and total + len(docs[i]) > BLOCK_TOKENS:
            yield block
            block, total = [], 0
        block.append(i)
        total += len(docs[i])
    if block:
        yield block


def _steps(docs: list[np.ndarray]):
    """Of documents sorted longest first: per step, how many still run; where each step
    starts among all; the classes of all documents, step by step."""
    lengths = np.array([len(d) for d in docs])
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    offsets = np.concatenate([[0], np.cumsum(live)])
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    seen = np.empty(offsets[-1], np.int64)
    seen[offsets[step] + np.repeat(np.arange(len(docs)), lengths)] = np.concatenate(docs)
    return live.tolist(), offsets.tolist(), seen


def log_likelihood(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each class sequence, by the scaled forward recursion; exact
    for whole documents of any length."""
    out, move, ones = np.zeros(len(docs)), model.move, np.ones((STATES, 1))
    for block in blocks(docs):
        live, offsets, seen = _steps([docs[i] for i in block])
        emitted, scales = model.emit[seen], np.empty((len(seen), 1))
        alpha = model.start
        for t, n in enumerate(live):
            at = slice(offsets[t], offsets[t + 1])
            alpha = (alpha[:n] @ move if t else alpha) * emitted[at]
            scale = scales[at] = alpha @ ones
            alpha /= scale
        logs, which = np.log10(scales[:, 0]), np.arange(len(seen)) - np.repeat(offsets[:-1], live)
        out[block] = np.bincount(which, logs, len(block))
    return out


def expected_counts(model: Model, docs: list[np.ndarray]):
    """Baum-Welch counts of whole documents: start, move, emit."""
    k, c = STATES, len(model.emit)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(c * k)
    ones, turned = np.ones((k, 1)), model.move.T.copy()
    for block in blocks(docs):
        live, offsets, seen = _steps([docs[i] for i in block])
        weighted, scales, alphas = model.emit[seen], np.empty((len(seen), 1)), np.empty((len(seen), k))
        alpha = model.start
        for t, n in enumerate(live):
            at = slice(offsets[t], offsets[t + 1])
            alpha = (alpha[:n] @ model.move if t else alpha) * weighted[at]
            scale = scales[at] = alpha @ ones
            alpha /= scale
            alphas[at] = alpha
        weighted /= scales
        back, beta, m = None, None, 0
        for t in range(len(live) - 1, -1, -1):
            n, at = live[t], slice(offsets[t], offsets[t + 1])
            if m:
                move += alphas[at][:m].T @ back
                beta = back @ turned
                if n > m:
                    beta = np.concatenate([beta, np.ones((n - m, k))])
                back = weighted[at] * beta
                alphas[at] *= beta
            else:
                back = weighted[at]
            m = n
        start += alphas[: live[0]].sum(0)
        emit += np.bincount((seen[:, None] * k + np.arange(k)).ravel(), alphas.ravel(), c * k)
    return start, move * model.move, emit.reshape(c, k)


def _word_counts(batches):
    """Local counts of words and ends, sent on before they outgrow the task."""

    def batch_of(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(text.as_py().lower().split())
            counts[END] += 1
            if len(counts) > FLUSH_WORDS:
                yield batch_of(counts)
                counts = Counter()
    if counts:
        yield batch_of(counts)


def training_counts(train: DataFrame) -> DataFrame:
    """word (binary; empty for the end sign), c: counts over all training rows."""
    local = train.select("text").mapInArrow(_word_counts, "word binary, c bigint")
    return local.groupBy("word").agg(F.sum("c").alias("c"))


def _encoded(shipped, slices: int, copies: int):
    """For each document a head row (slice null) with its classes, and for each slice of the
    vocabulary one row with its rare words there: texts are cut into words once."""

    def run(batches):
        top = shipped.value
        classes = worker_state(("hmm", hash(tuple(top))), lambda: Classes(top))
        for batch in pieces_of(batches, 2500):
            rows, ids, held = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            docs, out = [], {n: [] for n in ("row", "slice", "words", "times")}
            for row, text in zip(rows, batch.column(3), strict=True):
                words = text.as_py().lower().split()
                obs = [*map(classes.__getitem__, words), classes[END]]
                docs.append(np.array(obs, "<u2").tobytes())
                counts = Counter([w for w, c in zip(words, obs, strict=False) if c >= TOP] + [END] * int(obs[-1] >= TOP))
                by_slice: dict[int, tuple[list, list]] = {}
                for w, n in counts.items():
                    of = by_slice.setdefault((zlib.crc32(w) // HASHED) % slices, ([], []))
                    of[0].append(w)
                    of[1].append(n)
                for s, (rare, times) in by_slice.items():
                    out["row"].append(row)
                    out["slice"].append(s * copies + row % copies)
                    out["words"].append(b" ".join(rare))
                    out["times"].append(np.array(times, "<u4").tobytes())
            n, m = len(rows), len(out["row"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows + out["row"], pa.int64()), pa.concat_arrays([ids, pa.nulls(m, ids.type)]), pa.concat_arrays([held, pa.nulls(m, held.type)]), pa.array(docs + [None] * m, pa.binary()),
                 pa.array([None] * n + out["slice"], pa.int32()), pa.array([None] * n + out["words"], pa.binary()), pa.array([None] * n + out["times"], pa.binary())],
                names=["row", "doc_id", "held_out", "obs", "slice", "words", "times"],
            )

    return run


def _accumulate(shipped):
    """Fixed-point expected counts of a task: a row for each class that occurs, one
    (class -1) for the start and one (-2 - k) for each row of the moves."""

    def run(batches):
        model, (start, move, emit) = Model(*shipped.value), (0, 0, 0)
        for batch in pieces_of(batches, 5000):
            a, b, c = expected_counts(model, [np.frombuffer(x.as_py(), "<u2") for x in batch.column(0)])
            start, move, emit = start + a, move + b, emit + c
        if not isinstance(emit, np.ndarray):
            return
        used = np.flatnonzero(emit.sum(1))
        rows = np.vstack([start[None], move, emit[used]])
        ids = np.concatenate([[-1], -2 - np.arange(STATES), used])
        values = np.rint(rows * FIXED_POINT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *[pa.array(values[:, j]) for j in range(STATES)]], names=["id", *[f"k{j}" for j in range(STATES)]])

    return run


def _sums(rows: DataFrame, columns: int):
    """id and sums of k0, k1, ... of each id: at most as many rows as the model has classes."""
    return rows.groupBy("id").agg(*[F.sum(f"k{j}").alias(f"k{j}") for j in range(columns)]).toArrow().to_pydict()


def train_model(encoded: DataFrame, freq: np.ndarray) -> Model:
    """Baum-Welch over all rows of encoded (obs: classes as bytes). The driver gets a
    model-sized table of expected counts in each round."""
    spark, schema = encoded.sparkSession, "id int, " + ", ".join(f"k{j} bigint" for j in range(STATES))
    model = Model.new(freq)
    for _ in range(ROUNDS):
        shipped = spark.sparkContext.broadcast((model.start, model.move, model.emit))
        found = _sums(encoded.mapInArrow(_accumulate(shipped), schema), STATES)
        ids = np.array(found.pop("id"), int)
        values = np.array(list(found.values()), float).T.reshape(len(ids), STATES) / FIXED_POINT
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(freq), STATES))
        start[:] = values[ids == -1].sum(0)
        move[-2 - ids[ids < -1]] = values[ids < -1]
        emit[ids[ids >= 0]] = values[ids >= 0]
        model = Model.from_counts(start, move, emit, freq)
        shipped.unpersist()
    return model


def _scored(shipped):
    """Of each head row all that the fixed-size model knows; rare words are still to come."""

    def run(batches):
        (start, move, emit), top_counts, within = shipped.value
        model, rest = Model(start, move, emit), TOP + HASHED - len(top_counts)
        padded = np.concatenate([np.log10(top_counts + 0.5) if len(top_counts) else np.zeros(0), np.zeros(rest)])
        seen_top = np.concatenate([top_counts > 0, np.zeros(rest, bool)])
        log_within = np.concatenate([np.zeros(TOP), np.log10(within)])
        for batch in pieces_of(batches, 2500):
            docs = [np.frombuffer(x, "<u2") for x in batch.column(3).to_pylist()]
            score = log_likelihood(model, docs)
            lengths = np.array([len(d) for d in docs])
            flat, which = np.concatenate(docs) if docs else np.zeros(0, np.int64), np.repeat(np.arange(len(docs)), lengths)
            sums = lambda values: np.bincount(which, values[flat], len(docs))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(lengths.astype(np.int64)), pa.array(sums(seen_top).astype(np.int64)), pa.array(sums(padded)), pa.array(score - sums(log_within))],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
            )

    return run


PARTS = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"


def _look_up(batches):
    """First the words of this task's slices (times null), then blocks of rare words:
    the partial sums of each block."""
    counts: dict[bytes, int] = {}
    for batch in batches:
        rows, words, times, c = (batch.column(batch.schema.get_field_index(n)) for n in ("row", "words", "times", "c"))
        block = times.is_valid().to_numpy(zero_copy_only=False)
        if not block.all():
            own = pa.array(~block)
            counts.update(zip(words.filter(own).to_pylist(), c.filter(own).to_pylist(), strict=True))
        mask = pa.array(block)
        rows, blobs = rows.filter(mask), times.filter(mask).to_pylist()
        m = len(blobs)
        if m:
            n = np.frombuffer(b"".join(blobs), "<u4")
            found = np.fromiter((counts.get(w, 0) for w in b" ".join(words.filter(mask).to_pylist()).split(b" ")), np.int64, len(n))
            starts = np.cumsum([0, *[len(x) // 4 for x in blobs[:-1]]])
            total = pa.array(np.add.reduceat(n * np.log10(found + 0.5), starts))
            known = pa.array(np.add.reduceat(np.where(found > 0, n, 0).astype(np.int64), starts))
            yield pa.RecordBatch.from_arrays([rows, pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), known, total, total], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])


def hmm_scores(docs: DataFrame) -> DataFrame:
    """Trains on the rows whose crc32(doc_id as text) mod 5 is not 1 and scores all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and
    score (hidden Markov model), log10. A null text is empty: one end sign. A null
    doc_id hashes as an empty text. Rows that repeat a doc_id are scored one by one.
    Without training rows every token has the probability that smoothing leaves.
    Extra columns are ignored."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = docs.select("doc_id", held.alias("held_out"), text_bytes().alias("text"))
    train = rows.filter(~F.col("held_out"))
    counts = staged(training_counts(train).withColumn("hash", F.crc32("word")), "hmm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    first = counts.orderBy((F.length("word") == 0).desc(), F.desc("c"), "word").limit(TOP).collect()  # a bound that is part of the model
    top, top_counts = [bytes(r.word) for r in first], np.array([r.c for r in first], float)
    in_class, kinds = np.zeros(HASHED), np.zeros(HASHED)
    for r in counts.groupBy((F.col("hash") % HASHED).alias("h")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        in_class[r.h], kinds[r.h] = r.c, r.v
    for w, c in zip(top, top_counts, strict=True):
        in_class[hash_class(w) - TOP] -= c
        kinds[hash_class(w) - TOP] -= 1
    freq = np.concatenate([top_counts, np.zeros(TOP - len(top)), in_class]) + 0.5
    freq /= freq.sum()

    tasks = shuffle_partitions(spark)
    slices = max(SLICES, -(-distinct // SLICE_WORDS))
    copies = min(-(-tasks // slices), max(1, total // (20 * max(1, distinct))))  # copies of the vocabulary stay small beside the text
    numbered = with_row(rows).select(ROW, "doc_id", "held_out", "text")
    parts = staged(numbered.mapInArrow(_encoded(spark.sparkContext.broadcast(top), slices, copies), "row bigint, doc_id bigint, held_out boolean, obs binary, slice int, words binary, times binary"), "hmm-parts")
    heads = parts.filter("slice is null")
    model = train_model(heads.filter("not held_out").select("obs"), freq)
    shipped = spark.sparkContext.broadcast(((model.start, model.move, model.emit), top_counts, in_class + 0.5 * (kinds + 1)))
    scored = heads.select("row", "doc_id", "held_out", "obs").mapInArrow(_scored(shipped), PARTS)
    vocabulary = (
        counts.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "word", "c", "hash")
        .select((F.expr(f"cast(hash div {HASHED} % {slices} as int)") * copies + F.col("copy")).cast("int").alias("slice"), F.lit(None).cast("bigint").alias("row"), F.col("word").alias("words"), F.lit(None).cast("binary").alias("times"), "c")
    )
    blocks_ = parts.filter("slice is not null").select("slice", "row", "words", "times", F.lit(None).cast("bigint").alias("c"))
    found = vocabulary.unionByName(blocks_).repartitionById(slices * copies, "slice").sortWithinPartitions(F.col("times").isNotNull()).mapInArrow(_look_up, PARTS)
    log_all = math.log10(total + 0.5 * (distinct + 1))
    return (
        scored.unionByName(found).groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), "score")
    )


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))
