"""Each operator against a plain version of itself on small tables with awkward rows."""

import base64
import hashlib
import math
import random
import time
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("paperloom.llm")

from paperloom.llm import bpe, contamination, counts, features, graph, hmm, nearest, neardup, pieces, pii, quality, toxicity, warc  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AWKWARD = [None, "", " \t\n", "a", "A a a", "ß É 🙂 é", "x" * 5000, "  two  spaces\x00nul\x1cfs  "]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, start)], DOCS)


def words(n, rnd, size=60):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


def test_pieces_are_those_of_the_library(spark):
    encoder = pieces.PieceEncoder(pieces.model_bytes())
    rnd = random.Random(1)
    signs = list(" \t\n▁abcTheIng.éñ日本🙂0123 ") + ["  ", "the ", "́", "<s>"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(500)] + ["ab" * 2000, " " * 300]
    for t in texts:
        ids = [encoder.library.bos_id(), *encoder.library.encode(t), encoder.library.eos_id()]
        packed = encoder.packed(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert encoder.decode(packed) == encoder.library.decode(ids)
    rows = pieces.encode_decode(docs_of(spark, AWKWARD).withColumnRenamed("lang", "n_tokens"), pieces.model_bytes(), keep_ids=True).collect()
    assert len(rows) == len(AWKWARD) and rows[0].ids == [1, 2]
    for r, t in zip(sorted(rows, key=lambda r: r.doc_id), AWKWARD, strict=True):
        ids = [1, *encoder.library.encode(t or ""), 2]
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert pieces.encode_decode(docs_of(spark, []), pieces.model_bytes()).count() == 0


@pytest.mark.parametrize("text", ["a'" + "b" * 100_000, "e\u0301" * 50_000, "x" * 50_000 + "e\u0301" + "y" * 50_000, "don't" * 20_000, "ab<|endoftext|>" * 7_000, "Σ" * 100_000, "!" * 90_000 + "<|endoftext|>", "İ" * 50_000, "''" * 50_000 + "e\u0301"])
def test_prefix_tables_of_long_runs(text):
    """100 000 signs without white space take seconds, whatever is in them."""
    counter, began = counts.WordCounter(counts.tokenizer_bytes()), time.perf_counter()
    table = counter.prefixes(text)
    assert time.perf_counter() - began < 30
    for i in {1, 2, 1000, 1001, *random.Random(3).sample(range(len(text)), 5), len(text) - 1, len(text)}:
        assert table[i] == len(counter.library.encode(text[:i], add_special_tokens=False).ids)


def test_counts_are_those_of_the_library(spark):
    counter = counts.WordCounter(counts.tokenizer_bytes())
    rnd = random.Random(2)
    signs = list(" \t\nabcTheIng.éß日🙂012'\x1c\x85 ΣİΑ") + ["<|endoftext|>", "'re", "<|", "²", "é"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(500)]
    n = lambda t: len(counter.library.encode(t, add_special_tokens=False).ids)
    for t in texts:
        assert counter.count(t.encode()) == n(t)
    texts = ["Truncated words, counted exactly: naïve café <|endoftext|> 12", "can't we'll THEY'RE 'tis ''s", "日本語のテキスト、区切りなし。123", "e\u0301a\u0300 ΟΔΟΣ İi\u0307 \u00a0x\u2003y", *texts[:150]]
    for t in texts:
        assert counter.prefixes(t).tolist() == [n(t[:i]) for i in range(len(t) + 1)], t
    signs = [*"'st!1Σİé", "e\u0301", "\u0301", "\u0323", "\u0338", "=", "'re", "<|", "<|endof", "<|endoftext|>", "\u1100", "\u1161", "\u11a8", "\u0915", "\u093c", "\ufb01", "\u212b", "\xa0", "🙂", "x" * 70]
    for t in ("".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 15))) for _ in range(1500)):
        assert counter.prefixes(t).tolist() == [n(t[:i]) for i in range(len(t) + 1)], t
    for raw in ("thththe", "antidisestablishment", "aaaa", "x" * 300):
        assert list(counter.part(raw)) == [n(raw[: i + 1]) for i in range(len(raw))]
    rows = counts.count_tokens(docs_of(spark, AWKWARD).withColumnRenamed("lang", "over_limit"), counts.tokenizer_bytes(), limit=5, prefix_table=True)
    rows = rows.withColumn("cut", counts.truncated_at(rows.prefixes, 2)).withColumn("two", counts.tokens_at(rows.prefixes, 2)).orderBy("doc_id").collect()
    for r, t in zip(rows, AWKWARD, strict=True):
        t = t or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n(t), n(t) > 5)
        assert r.cut == max(i for i in range(len(t) + 1) if n(t[:i]) <= 2) if len(t) < 100 else n(t[: r.cut]) <= 2 < n(t[: r.cut + 1])
        assert r.two == (n(t[:2]) if len(t) >= 2 else None)
    assert counts.count_tokens(docs_of(spark, []), counts.tokenizer_bytes()).count() == 0


def test_long_texts_are_counted_whole(spark):
    rnd = random.Random(16)
    texts = ["".join(rnd.choice("abcdé 'xyz日") for _ in range(60_000)), "don't" * 5000, "word " * 40_000]
    library = counts.WordCounter(counts.tokenizer_bytes()).library
    for r in counts.count_tokens(docs_of(spark, texts), counts.tokenizer_bytes()).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_prefix_table_equals_plain_merging():
    merges = {("a", "b"): 0, ("ab", "ab"): 1, ("b", "a"): 2, ("abab", "a"): 3, ("c", "a"): 4}
    table = bpe.PrefixTable(["a", "b", "c", "ab", "abab", "ba", "ababa", "ca"], lambda x, y: merges.get((x, y)))
    rnd = random.Random(3)
    for _ in range(500):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 14)))
        assert table.encode(word) == table.merged(list(word))


def test_words_in_order_share_their_beginnings():
    merges = {("a", "b"): 0, ("ab", "ab"): 1, ("b", "a" + bpe.END): 2, ("abab", "a"): 3, ("c", "a"): 4, ("ab", "c" + bpe.END): 5}
    tokens = ["a", "b", "c", "ab", "abab", "ababa", "ca", *(t + bpe.END for t in ("a", "b", "c", "ba", "abc"))]
    table, rnd, worked = bpe.PrefixTable(tokens, lambda x, y: merges.get((x, y)), end_of_word=True), random.Random(5), []

    class Seen(str):
        def __getitem__(self, k):
            worked.append(len(str.__getitem__(self, k)))
            return str.__getitem__(self, k)

    found = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(14))) for _ in range(500)})
    for order in (found, found[::-1], rnd.sample(found, len(found))):
        for word, closed in zip(order, table.closed_tables(map(Seen, order)), strict=True):
            assert closed == [0, *(len(table.merged(table.symbols(word[:i] + bpe.END))) for i in range(1, len(word) + 1))]
    worked.clear()
    assert len(list(table.closed_tables(Seen("ab" * 500 + end) for end in ("a", "b", "ba", "c")))) == 4
    assert sum(worked) == 1000 + 1 + 1 + 1 + 1


def test_counts_of_a_batch_join_no_tables(monkeypatch):
    """The sum needs the tables of pre-tokens, each made once, and none of the runs they stand in."""
    monkeypatch.setattr(counts, "SLICE", 300)
    monkeypatch.setattr(counts, "CACHE_LIMIT", 40)
    counter, rnd = counts.WordCounter(counts.tokenizer_bytes()), random.Random(6)
    monkeypatch.setattr(counter, "run", None)
    signs = [*"abTh.,'\x1c\x85\x00\x7f ΣéÉ日1\xa0", "<|endoftext|>", "<|", " the", " the", "'re", " " + "x" * 70]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(300)] + ["", " ", "then then. Then, then!" * 40]
    n = [len(counter.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.counts([t.encode() for t in texts]) == n == counter.counts([t.encode() for t in texts])
    assert counter.counts([]) == []
    assert not [raw for kept in (counter.known, counter.past, counter.known_parts, counter.past_parts) for raw in kept if len(raw) > counts.CACHED_LENGTH]


def test_hmm_scores(spark):
    rnd = random.Random(4)
    texts = [*AWKWARD, *[words(rnd.randrange(1, 60), rnd, 400) for _ in range(120)]]
    docs = docs_of(spark, texts)
    docs = docs.union(docs.filter("doc_id = 9")).union(spark.createDataFrame([(None, "w1 zz", None, None, None)], DOCS)).withColumnRenamed("lang", "score")
    rows = hmm.hmm_scores(docs).collect()
    assert len(rows) == len(texts) + 2
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    everything = [(r.doc_id, r.text) for r in docs.collect()]
    c = Counter(w for i, t in everything if i is None or not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = tokens("w1 zz" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score <= 0 and math.isfinite(r.score)
    empty = hmm.hmm_scores(docs_of(spark, []))
    assert empty.count() == 0


def plain_hmm(texts, train):
    """The scores of all texts by a plain version: no blocks, no slices, no fixed point."""
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i in train for w in tokens(texts[i]))
    top = sorted(c, key=lambda w: (w != b"", -c[w], w))[: hmm.TOP]
    place, n = {w: i for i, w in enumerate(top)}, hmm.TOP + hmm.HASHED
    of = lambda w: place.get(w, hmm.TOP + zlib.crc32(w) % hmm.HASHED)
    total, kinds, freq = Counter(), Counter(), np.full(n, 0.5)
    for w, m in c.items():
        freq[of(w)] += m
        if w not in place:
            total[of(w)] += m
            kinds[of(w)] += 1
    freq /= freq.sum()
    docs = [[of(w) for w in tokens(t)] for t in texts]
    model = hmm.Model.new(freq)

    def forward(d):
        out, scale = [], []
        for t, x in enumerate(d):
            a = (model.start if t == 0 else out[-1] @ model.move) * model.emit[x]
            scale.append(a.sum())
            out.append(a / a.sum())
        return out, scale

    for _ in range(hmm.ROUNDS):
        start, move, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((n, hmm.STATES))
        for d in (docs[i] for i in train):
            alpha, scale = forward(d)
            beta = np.ones(hmm.STATES)
            for t in range(len(d) - 1, -1, -1):
                emit[d[t]] += alpha[t] * beta
                if t:
                    back = model.emit[d[t]] * beta / scale[t]
                    move += model.move * np.outer(alpha[t - 1], back)
                    beta = model.move @ back
            start += alpha[0] * beta
        model = hmm.Model.from_counts(start, move, emit, freq)
    rare = lambda w: math.log10((c[w] + 0.5) / (total[of(w)] + 0.5 * (kinds[of(w)] + 1))) if w not in place else 0.0
    return [sum(map(math.log10, forward(d)[1])) + sum(map(rare, tokens(t))) for d, t in zip(docs, texts, strict=True)]


def test_hmm_scores_equal_a_plain_version_in_any_layout(spark, monkeypatch):
    for name, value in (("TOP", 40), ("HASHED", 16), ("SLICES", 3), ("BLOCK_TOKENS", 50), ("FLUSH_WORDS", 20)):
        monkeypatch.setattr(hmm, name, value)
    rnd = random.Random(15)
    texts = [*AWKWARD, "w1 " * 30_000, *[words(rnd.randrange(1, 40), rnd, 120) for _ in range(80)]]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    want = plain_hmm(texts, train)
    docs = docs_of(spark, texts).withColumnRenamed("lang", "held_out").withColumnRenamed("source", "row")
    for layout in (docs.coalesce(1), docs.repartition(7, "text")):
        for r in hmm.hmm_scores(layout).collect():
            assert r.score == pytest.approx(want[r.doc_id], rel=1e-4)


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(5)
    model = hmm.Model(rng.dirichlet(np.ones(8)), rng.dirichlet(np.ones(8), 8), rng.dirichlet(np.ones(12), 8).T)
    docs = [rng.integers(0, 12, n) for n in (1, 7, 3, 7, 20)]
    for d, got in zip(docs, hmm.log_likelihood(model, docs), strict=True):
        a = model.start * model.emit[d[0]]
        for x in d[1:]:
            a = (a @ model.move) * model.emit[x]
        assert got == pytest.approx(np.log10(a.sum()))
    start, move, emit = hmm.expected_counts(model, docs)
    assert start.sum() == pytest.approx(5) and move.sum() == pytest.approx(38 - 5) and emit.sum() == pytest.approx(38)
    before = hmm.log_likelihood(model, docs).sum()
    for _ in range(10):  # plain Baum-Welch never lowers the likelihood
        start, move, emit = hmm.expected_counts(model, docs)
        model = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        now = hmm.log_likelihood(model, docs).sum()
        assert now >= before - 1e-9
        before = now


def test_model_beats_the_unigram_on_held_out_texts(spark):
    rows = hmm.op1_hmm(spark, "/root/testdata/sf0.001").filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > 0.99 * rows["sum(base_score)"]


def plain_components(texts, percent=85):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    top = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    return [len(s) for s in sets], top


def near_texts(rnd):
    texts = []
    for _ in range(12):
        base = words(120, rnd, 5000).split()
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(6)):
            copy = base[:]
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = f"z{rnd.random()}"
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), texts[0], texts[0] + " ", *AWKWARD, "a", "same five words are here", "same five words are here"]
    rnd.shuffle(texts)
    return texts


SMALL = {"LEAF": 3, "FEW": 1, "BLOCK": 2, "SETS": 2}  # takes every branch of the join


def test_near_duplicates(spark, monkeypatch):
    texts = near_texts(random.Random(6))
    sizes, top = plain_components(texts)
    other = "a text that no other row of the table is like, under an id that another row has"
    for small in ({}, SMALL):
        for name, value in small.items():
            monkeypatch.setattr(neardup, name, value)
        docs = docs_of(spark, texts).withColumnRenamed("source", "digest")
        extra = spark.createDataFrame([(None, texts[0], None, None, None), (0, texts[0], None, None, None), (3, other, None, None, None)], DOCS)
        rows = neardup.near_duplicates(docs.union(extra)).collect()
        assert len(rows) == len(texts) + 3
        assert (14, 3, True) in {(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id == 3}
        for r in rows:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            elif (r.doc_id, r.n_shingles) != (3, 14):
                assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], top[r.doc_id], r.doc_id == top[r.doc_id])
    kept = neardup.without_near_duplicates(docs.union(extra)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None and r.text is not None) == sorted([*((i, texts[i]) for i in set(top) if texts[i] is not None), (3, other)])
    assert sum(r.doc_id is None for r in kept) == 1 and sum(r.text is None for r in kept) == sum(t is None for t in texts)
    assert list(kept[0].asDict()) == docs.columns and neardup.near_duplicates(docs_of(spark, [])).count() == 0


def linked_pairs(texts, percent=85):
    """All links of texts by brute force."""
    sets = [neardup.shingle_set((t or "").encode(), neardup.WordHashes()) for t in texts]
    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            holders.setdefault(x, []).append(i)
    shared = Counter((i, j) for own in holders.values() for a, j in enumerate(own) for i in own[:a])
    return {(i, j) for (i, j), n in shared.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)}


def test_recall_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    links = linked_pairs([r.text for r in rows])
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    ids = [r.doc_id for r in rows]
    assert len(links) > 50 and sum(found[ids[i]] == found[ids[j]] for i, j in links) >= 0.99 * len(links)
    top = {i: i for i in ids}
    for i, j in sorted(links):
        a, b = top[ids[i]], top[ids[j]]
        top = {k: min(a, b) if v in (a, b) else v for k, v in top.items()}
    assert all(top[found[i]] == top[i] for i in ids)  # nothing is joined without a link


def passages(rnd, n):
    """Pairs of near copies that all hold one long passage: one node of a tree holds most."""
    passage, texts = words(60, rnd, 10_000), []
    for _ in range(n):
        own = words(40, rnd, 10_000)
        texts += [f"{passage} {own}", f"{passage} {own} {words(12, rnd, 10_000)}"]
    return texts


@pytest.mark.parametrize("sizes", [{"FIRST_TREES": 6, "ALL_TREES": 6, "LEAF": 4}, {"LEAF": 16, "FEW": 12, "BLOCK": 8, "SETS": 8}])
def test_large_nodes_lose_no_links(spark, monkeypatch, sizes):
    # all trees are trees of the first phase, which only deals large nodes out around a pivot;
    # or large nodes branch level by level
    for name, value in sizes.items():
        monkeypatch.setattr(neardup, name, value)
    texts = passages(random.Random(21), 150)
    links = linked_pairs(texts)
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert len(links) >= 150 and sum(found[i] == found[j] for i, j in links) >= 0.99 * len(links)
    assert len(set(found.values())) >= len(texts) - len(links)


def test_sketches_spare_no_pair_at_the_threshold():
    rng, n = np.random.default_rng(23), 20_000
    agree = rng.binomial(neardup.SKETCH, 0.85, n)
    assert (agree >= neardup.least_agreement(0.85)).sum() >= n - 3
    same = np.arange(200 * neardup.SKETCH, dtype=np.uint32).reshape(200, -1)
    same[7] = same[150]
    hit = neardup.likely(same, np.full(200, 50.0), np.arange(200), 0.85)
    assert np.flatnonzero(hit).tolist() == [7, 150]
    assert not neardup.likely(same, np.full(200, 50.0), np.where(np.arange(200) == 7, 150, np.arange(200)), 0.85).any()


def test_pairs_at_the_threshold_share_nodes_at_any_depth():
    rng, n = np.random.default_rng(22), 400
    one = rng.integers(0, 1 << 32, (n, neardup.SKETCH), np.uint32)
    sketches = np.stack([one, np.where(rng.random(one.shape) < 0.85, one, ~one)], 1).reshape(2 * n, -1)  # rows 2i and 2i + 1 are a pair
    rep, node = np.arange(2 * n), np.repeat(rng.integers(0, 1 << 62, n), 2)
    branch = neardup._next_children(0.85)
    for _ in range(neardup.DEPTH):
        marks = pa.array([sketches[r].tobytes() for r in rep], pa.binary())
        [out] = branch([pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.zeros(len(rep), np.int32)), pa.array(rep), marks, marks], names=["node", "tree", "rep", "digest", "sketch"])])
        found = {(r // 2, x, r % 2) for r, x in zip(out.column(2).to_pylist(), out.column(0).to_pylist(), strict=True)}
        both = [(2 * i + side, x) for i, x, side in sorted(found) if (i, x, 1 - side) in found]
        assert both
        rep, node = (np.array(c, np.int64) for c in zip(*both, strict=True))
    assert len(set(rep // 2)) >= 0.62 * n  # of one tree; all eight then miss under 0.1 %


def test_components_in_both_ways(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    top = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = top[a], top[b]
        top = {k: min(x, y) if v in (x, y) else v for k, v in top.items()}
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    for small in (0, 10_000):
        found = {r.id: r.label for r in graph.components(frame, small).collect()}
        assert found == {k: v for k, v in top.items() if k in found} and set(found) == {x for a, b in edges if a != b for x in (a, b)}


def test_contamination(spark):
    rnd = random.Random(8)
    items = [words(n, rnd, 30) for n in (3, 7, 10, 11, 25, 40)] + ["", None, "One-two THREE", words(40, rnd, 2)]
    texts = [*AWKWARD, *[words(60, rnd, 30) for _ in range(10)]]
    for item in items[:6]:
        w = item.split()
        texts.append("before " + item.upper().replace(" ", ", ") + " after")
        texts.append(" ".join(w[: len(w) // 2]) + " cut " + " ".join(w[len(w) // 2 :]))
    docs = docs_of(spark, texts).withColumnRenamed("lang", "row")
    unnamed = "an item without any id that is longer than one whole window"
    texts.append("so " + unnamed + " ends")
    docs = docs_of(spark, texts).withColumnRenamed("lang", "row")
    bench = spark.createDataFrame([*enumerate(items), (2, items[2]), (None, unnamed)], "item_id bigint, text string")
    rows = contamination.contamination(docs.union(docs.filter("doc_id = 20")), bench).collect()
    assert len(rows) == len(texts) + 1
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    for r in rows:
        w, hit, found = split(texts[r.doc_id]), set(), set()
        for i, item in enumerate([*items, unnamed]):
            v = split(item)
            m = min(len(v), 10)
            if m:
                windows = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)}
                for k in range(len(w) - m + 1):
                    if tuple(w[k : k + m]) in windows:
                        hit |= set(range(k, k + m))
                        found |= {str(i)} if i < len(items) else set()
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), sha, bool(hit))
    assert contamination.contamination(docs_of(spark, []), bench).count() == 0
    assert contamination.contamination(docs_of(spark, texts), bench.limit(0)).filter("contaminated").count() == 0
    bad = {r.doc_id for r in rows if r.contaminated}
    kept = contamination.without_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - bad and kept.columns == docs.columns
    some = min(bad)
    shared = spark.createDataFrame([(None, "clean words", "", "", 1), (None, texts[some], "", "", 1), (some, "clean words", "", "", 1), (some, None, "", "", 1)], docs.schema)
    assert sorted((r.doc_id or -1, r.text or "") for r in contamination.without_contaminated(shared, bench).collect()) == [(-1, "clean words"), (some, ""), (some, "clean words")]


def luhn_ok(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark):
    rnd = random.Random(9)
    signs = list("abc.@%+-_ 0123456789()\n") + ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+49 (30) 123456-78", "256.1.1.1", "é🙂", "1.1.1.1.1", "@c.d%e@f.gh"]
    texts = [*AWKWARD, *["".join(rnd.choice(signs) for _ in range(rnd.randrange(30))) for _ in range(300)], "9" * 20000, "a." * 8000, "x@" + "a." * 8000 + "b", "1 " * 9000]
    ibans = ["DE89370400440532013000 BIC X", "NO93 8601 1117 947 AND MORE", "xDE89370400440532013000", "DE89370400440532013000A"]
    texts += ["bank DE89370400440532013000", "bank DE88370400440532013000", "SSN 123-45-6789", "part 123-45-6789", "ssn 1123-45-6789"]
    rows = {r.doc_id: r for r in pii.find_pii(docs_of(spark, texts).withColumnRenamed("lang", "pii")).collect()}
    assert [[s.match for s in r.pii] for r in pii.find_pii(docs_of(spark, ibans)).orderBy("doc_id").collect()] == [[ibans[0][:22]], [ibans[1][:18]], [], []]
    scores = pii.find_pii(docs_of(spark, ["mail a@b.co", "a@b.co", "recipe 1.2.3.4", "ip 1.2.3.4", "hosts: 1.2.3.4"])).orderBy("doc_id").collect()
    assert [round(r.pii[0].score, 2) for r in scores] == [1.0, 0.9, 0.6, 0.8, 0.8]
    checks = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn_ok(re.sub("[^0-9]", "", m)), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    for i, t in enumerate(texts):
        if t and len(t) > 5000:
            continue
        want = sorted((m.start(), place, m.end(), kind) for place, (kind, p) in enumerate(pii.BASE.items()) for m in re.finditer(p, t or "") if checks[kind](m[0]))
        assert [(s.start, s.place, s.end, s.kind) for s in rows[i].pii if s.kind in pii.BASE] == want, t
    added = [[s.kind for s in rows[len(texts) - 5 + k].pii if s.kind in pii.ADDED] for k in range(5)]
    assert added == [["iban"], [], ["ssn"], [], []]
    assert len(rows[len(texts) - 7].pii) == 1 and len(rows) == len(texts)
    back = pii.redacted(docs_of(spark, ["call a@b.co or 1.2.3.4", None, "x"])).orderBy("doc_id").collect()
    assert [r.text for r in back] == ["call [EMAIL] or [IP]", None, "x"]
    assert pii.find_pii(docs_of(spark, [])).count() == 0


def test_warc(spark):
    html = ["<p>é</p>", "<p>é</p>", "", None, "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n", "x" * 50000, "<p>é</p>", "\n\n", "a\r\n"]
    pages = spark.createDataFrame([(i, f"https://WWW.Example.com:80/{i % 3}?b\r\nc" if i else None, h) for i, h in enumerate(html)] + [(6, "http://b.c/", "<p>é</p>"), (None, "u", "n")], "page_id bigint, url string, html string")
    rows = warc.archived(pages.selectExpr("*", "1 AS size", "'x' AS key", "'y' AS head")).collect()
    assert len(rows) == len(html) + 2
    text = lambda h: (h or "").encode()
    for r in rows:
        h = text("n" if r.page_id is None else html[r.page_id])
        assert (r.payload_bytes, r.payload_digest) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        same = [i for i, x in enumerate(html) if text(x) == h]
        assert r.refers_to in (None, max(same, default=None))
        assert (r.record_type == "revisit") == (r.refers_to is not None)
    assert sum(r.record_type == "response" for r in rows) == len({text(h) for h in html}) + 1
    keys = [(r.url_key.encode(), r.taken, -1 if r.page_id is None else r.page_id) for r in rows]
    assert keys == sorted(keys)
    assert warc.archived(pages.limit(0)).count() == 0


def test_repeated_page_with_equal_payload_has_one_response(spark):
    pages = spark.createDataFrame([(7, "http://a/", "same")] * 3 + [(2, "http://b/", "same"), (7, "http://a/", "other")], "page_id bigint, url string, html string")
    kinds = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(pages).collect())
    assert kinds == {(7, 4, "response", None): 1, (7, 4, "revisit", 7): 2, (2, 4, "revisit", 7): 1, (7, 5, "response", None): 1}


@pytest.mark.parametrize("hot", [1, 4, 1 << 16])
def test_frequent_payloads_and_rare_ones_give_the_same_records(spark, monkeypatch, hot):
    """One payload is half of all rows, another a tenth, others come once or twice."""
    monkeypatch.setattr(warc, "HOT", hot)
    html = [("hot" * 500 if i % 2 else "warm" if i % 10 == 0 else f"p{i // 4}" if i % 4 == 0 else f"q{i}") for i in range(2000)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id bigint, url string, html string").repartition(4, "page_id")
    last = {h: i for i, h in enumerate(html)}
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.archived(pages).collect()}
    want = {i: ("response", None) if last[h] == i else ("revisit", last[h]) for i, h in enumerate(html)}
    assert got == {i: (*w, len(html[i]), base64.b32encode(hashlib.sha1(html[i].encode()).digest()).decode()) for i, w in want.items()}


def test_broken_records_are_named(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", "other"), (4, "http://c/", "same"), (5, "u", None)], "page_id bigint, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), "run")
    records = warc.read_archives(spark, str(tmp_path / "w"), "run").cache()
    assert records.count() == 5 and warc.broken(records).count() == 0
    torn = records.filter("record_type = 'revisit' or payload != cast('same' as binary)")
    assert [r.reason for r in warc.broken(torn).collect()] == ["no such response"]
    changed = records.withColumn("payload", warc.F.expr("if(payload = cast('other' as binary), cast('othe!' as binary), payload)"))
    assert [r.reason for r in warc.broken(changed).collect()] == ["payload differs from its record"]
    stated = records.withColumn("length", warc.F.expr("if(record_type = 'revisit', length + 1, length)"))
    assert [r.reason for r in warc.broken(stated).collect()] == ["revisits state another payload"]


def captured(rows):
    return pa.RecordBatch.from_pylist([{"url_key": u, "taken": t, "page_id": p} for u, t, p in rows], schema=pa.schema([("url_key", pa.string()), ("taken", pa.string()), ("page_id", pa.int64())]))


def test_merge_holds_about_a_block_of_each_run(monkeypatch):
    monkeypatch.setattr(warc, "PENDING", 100)
    monkeypatch.setattr(warc, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: len(sizes)})())}))
    rnd, sizes, blocks, every = random.Random(20), [], [], []
    for _ in range(30):
        rows = sorted((f"u{rnd.randrange(50):02}", f"t{rnd.randrange(9)}", rnd.randrange(10_000)) for _ in range(2000))
        every += rows
        [out] = warc._blocks([])(iter([captured(rows)]))
        blocks += out.to_pylist()
        sizes.append(len(rows))
    blocks.sort(key=lambda b: (b["url_key"], b["taken"], b["page_id"], b["run"]))
    held = []
    monkeypatch.setattr(warc._Runs, "__init__", lambda self: (setattr(self, "of", {}), setattr(self, "size", 0), setattr(self, "most", 0), held.append(self))[0])
    names = ["range", "run", "url_key", "taken", "page_id", "block"]
    batches = (pa.RecordBatch.from_pylist(blocks[i : i + 50], schema=pa.schema([("range", pa.int32()), ("run", pa.int32()), ("url_key", pa.string()), ("taken", pa.string()), ("page_id", pa.int64()), ("block", pa.binary())])) for i in range(0, len(blocks), 50))
    got = [tuple(r[n] for n in names[2:5]) for b in warc._merged(batches) for r in b.to_pylist()]
    assert got == sorted(every)
    assert held[0].most <= 31 * warc.BLOCK + 100 < len(every) / 20


def test_capture_index_is_in_one_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    monkeypatch.setattr(warc, "PENDING", 10)
    rnd = random.Random(21)
    rows = [(f"u{min(rnd.randrange(9), 4)}", f"t{rnd.randrange(5)}", rnd.choice([None, *range(40)]), "response", None, 1, "d") for _ in range(900)]
    frame = spark.createDataFrame(rows, "url_key string, taken string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string").repartition(7)
    got = [(r.url_key, r.taken, -1 if r.page_id is None else r.page_id) for r in warc.capture_index(frame).collect()]
    assert got == sorted((u, t, -1 if p is None else p) for u, t, p, *_ in rows)


def test_loser_tree():
    rnd = random.Random(10)
    for k in range(9):
        runs = [sorted(rnd.randrange(20) for _ in range(rnd.randrange(9))) for _ in range(k)]
        assert [x for _, x in warc.LoserTree(runs)] == sorted(sum(runs, []))


@pytest.mark.parametrize("sizes", [{}, {"UNIT": 40, "QUERY_BLOCK": 2, "STEP": 3, "ANNULUS": 7, "PIVOTS": 9}])
def test_top_k(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(11)
    vectors = [v.tolist() for v in rng.normal(0, 0.2, (400, 6)).astype("float32")]
    vectors[7] = vectors[50] = vectors[51] = vectors[100]
    bad = [None, [None, 1.0], [float("nan")], [float("inf")]]
    rows = [*enumerate(vectors), (150, vectors[3]), (500, [0.5]), (550, []), *[(600 + i, b) for i, b in enumerate(bad)], (None, vectors[0])]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id bigint, embedding array<float>, pivot int, unit string, score int")
    good = [(i, np.pad(np.floor(256 * np.array(v, "float32").astype(float)), (0, 6 - len(v)))) for i, v in rows if i is not None and i < 600]
    want = []
    for a, (i, q) in enumerate(good):
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for b, (j, v) in enumerate(good) if b != a)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in nearest.top_k(frame).collect()) == sorted(want)
    assert nearest.top_k(frame.limit(0)).count() == 0
    assert sorted(tuple(r) for r in nearest.top_k(frame.filter("vec_id in (0, 1)")).collect())[0][:3] == (0, 1, 1)


def test_distant_annuli_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(nearest, "UNIT", 50)
    rng, seen = np.random.default_rng(19), spark.sparkContext.accumulator(0)
    centres = rng.normal(0, 1, (20, 8))
    centres *= 4 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.01, 8)).tolist()) for i in range(2000)]
    plain = nearest.scores

    def counted(q, v):
        seen.add(q.shape[0] * v.shape[0])
        return plain(q, v)

    monkeypatch.setattr(nearest, "scores", counted)
    assert nearest.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).count() == 200
    assert 0 < seen.value < 0.5 * 40 * 2000


def test_scores_beyond_64_bits_are_an_error(spark):
    frame = spark.createDataFrame([(0, [3e9]), (1, [5e9])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        nearest.top_k(frame)
    fits = spark.createDataFrame([(0, [4e6, 1.0]), (1, [5e6, 2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in nearest.top_k(fits).collect()] == [(0, 1, 1, 65536 * 20 * 10**12 + 65536 * 2)]


def test_large_numbers_stay_exact():
    q, v = np.array([[1 << 30, 3]]), np.array([[1 << 30, 5], [(1 << 30) - 1, 7]])
    assert nearest.scores(q, v).tolist() == [[(1 << 60) + 15, (1 << 60) - (1 << 30) + 21]]


def labelled(spark, rnd, n=400):
    texts, toxic = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = words(40, rnd, 300).split()
        if bad:
            for k in range(1 + i // 4 % 4):
                w[rnd.randrange(len(w))] = ["badword", "uglyword", "meanword"][k % 3]
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return docs_of(spark, [*texts, *AWKWARD]), spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic) if i % 2 == 0], "doc_id bigint, quality int, toxic int"), toxic


def test_toxicity(spark):
    docs, labels, toxic = labelled(spark, random.Random(12))
    model = toxicity.train(docs, labels.union(labels.limit(3)))
    rows = toxicity.score_toxicity(docs.withColumnRenamed("lang", "grade"), model, ["doc_id", "grade", "source"]).collect()
    assert len(rows) == len(toxic) + len(AWKWARD) and rows[0].source == "s"
    held = [(r.toxic, toxic[r.doc_id]) for r in rows if r.doc_id < len(toxic) and r.doc_id % 2 == 1]
    assert sum(a == bool(b) for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r.severity <= 3 for r in rows) and all(np.diff(model.thresholds) > 0)
    few, many = (toxicity.sigmoid(model.scorer()(" ".join(["badword"] * n)) - model.thresholds).sum() for n in (1, 4))
    assert many > few
    left = toxicity.without_toxic(docs.withColumnRenamed("lang", "severity"), model)
    assert left.columns == ["doc_id", "text", "severity", "source", "n_chars"] and left.count() == sum(not r.toxic for r in rows)
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, none, ["doc_id"]).filter("toxic").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model, ["doc_id"]).count() == 0


def test_toxicity_equals_a_plain_fit(spark):
    docs, labels, toxic = labelled(spark, random.Random(17))
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {i: toxic[i] for i in range(0, len(toxic), 2)}
    order = {r.doc_id: n for n, r in enumerate(docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").collect())}
    ids = sorted(known, key=order.__getitem__)
    y, bags = np.array([known[i] for i in ids]), [toxicity.bag(texts[i]) for i in ids]
    n, ones, df, hit = len(y), int(y.sum()), Counter(f for b in bags for f in b), Counter(f for b, t in zip(bags, y, strict=True) if t for f in b)
    chi2 = lambda f: (hit[f] - df[f] * ones / n) ** 2 * n**3 / (ones * (n - ones) * df[f] * (n - df[f]))
    strong = sorted((f for f in df if 5 <= df[f] < n and hit[f] * n > df[f] * ones and chi2(f) >= 30), key=lambda f: (-chi2(f), f))
    place = {f: i for i, f in enumerate(strong)}
    sparse = [[(place[f], v) for f, v in b.items() if f in place] for b in bags]
    rows = features.Rows([np.array([i for i, _ in r], np.int64) for r in sparse], [np.array([v for _, v in r], float) for r in sparse], len(place))
    amount = rows.times(toxicity.fit_binary(rows, y)[:-1])
    found = (y == 1) & (amount > 0)
    cuts = np.quantile(amount[found], [1 / 3, 2 / 3])
    w, theta = toxicity.fit_ordinal(rows, np.where(y == 1, 1 + np.where(found, (amount[:, None] > cuts).sum(1), 0), 0))
    want = lambda t: sum(1 / (1 + math.exp(x - sum(w[place[f]] * v for f, v in toxicity.bag(t or "").items() if f in place and abs(w[place[f]]) > 1e-4))) for x in theta)
    for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels), ["doc_id"]).collect():
        assert r.severity == pytest.approx(want(texts[r.doc_id]), abs=1e-6)


def test_ordinal_fit_finds_the_likeliest_thresholds():
    rng = np.random.default_rng(18)
    grade = rng.choice(4, 500, p=[0.5, 0.2, 0.2, 0.1])
    rows = features.Rows([np.zeros(0, np.int64)] * 500, [np.zeros(0)] * 500, 0)
    _, theta = toxicity.fit_ordinal(rows, grade)
    weight = np.where(grade > 0, 2.0, 1.0)  # without features the fit is the weighted share
    assert toxicity.sigmoid(-theta) == pytest.approx([weight[grade > j].sum() / weight.sum() for j in range(3)], abs=0.01)


def marked(spark, rnd, n=500):
    texts, good = [], []
    for i in range(n):
        t = words(50, rnd, 300)
        texts.append(t if i % 4 else " ".join(x + "%%%" for x in t.split()))
        good.append(int(bool(i % 4)))
    docs = spark.createDataFrame([(i, t, "en", "farm" if i < n and i % 8 == 0 else "s", len(t or "")) for i, t in enumerate([*texts, *AWKWARD])], DOCS)
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good) if i % 2] + [(i, good[i], 0) for i in range(0, 200, 2)], "doc_id bigint, quality int, toxic int")
    return docs, labels, texts, good


def test_quality(spark):
    docs, labels, texts, good = marked(spark, random.Random(13))
    repeated = spark.createDataFrame([(3, texts[0], "en", "s", 9), (None, texts[1], None, None, None)], DOCS)
    rows = quality.graded(docs.union(repeated).withColumn("p_meta", F.col("lang")), labels, ["doc_id", "p_meta", "source"]).collect()
    assert len(rows) == len(texts) + len(AWKWARD) + 2 and all(0 <= r.quality <= 1 and isinstance(r.p_meta, float) for r in rows)
    held = [(r.good, good[r.doc_id]) for r in rows if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 2 == 0 and r.doc_id >= 200]
    assert sum(a == bool(b) for a, b in held) >= 0.95 * len(held)
    assert sorted(r.good for r in rows if r.doc_id == 3) == [False, True]  # each row by its own text
    assert quality.graded(docs, labels.limit(0), ["doc_id"]).filter("quality = 0.5").count() == docs.count()
    assert quality.graded(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_quality_equals_plain_co_training(spark):
    docs, labels, texts, good = marked(spark, random.Random(14), 900)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    order = {r.doc_id: n for n, r in enumerate(docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").collect())}
    known = {i: good[i] for i in range(900) if i % 2 or i < 200}
    packed = [[quality.hashed(quality.text_view(r.text or ""), quality.WIDTHS[0]) for r in rows], [quality.hashed(quality.meta_view(r.source, r.lang, r.n_chars), quality.WIDTHS[1]) for r in rows]]
    first: dict = {}
    for i in sorted(known):
        first.setdefault(texts[i], i)
    ids = sorted(first.values(), key=order.__getitem__)
    y, held = np.array([known[i] for i in ids]), np.arange(len(ids)) % 5 == 0
    of = lambda v, chosen: quality.Rows([packed[v][i] for i in chosen], quality.WIDTHS[v])
    start, test, pool = [i for i, h in zip(ids, held, strict=True) if not h], [i for i, h in zip(ids, held, strict=True) if h], [i for i in range(len(rows)) if i not in known]
    now, given, share = [quality.fit(of(v, start), y[~held]) for v in (0, 1)], ({}, {}), y[~held].mean()
    for _ in range(quality.ROUNDS):
        new, rules = [], []
        for giver in (0, 1):
            free = [i for i in pool if i not in given[1 - giver]]
            s = of(giver, free).times(now[giver])
            counts = np.bincount(np.clip((s + 16) * 128, 0, 4095).astype(int), minlength=4096)
            high, low = quality._cuts(counts, *quality.calibrated(of(giver, test).times(now[giver]), y[held]), share)
            rules.append((high, low) != (math.inf, -math.inf))
            new.append({i: int(x >= high) for i, x in zip(free, s, strict=True) if x >= high or x < low})
        if not any(rules):
            break
        for giver in (0, 1):
            given[1 - giver].update(new[giver])

        def gradient(x):
            out = []
            for v, part in enumerate(np.split(x, [quality.WIDTHS[0] + 1])):
                g = of(v, start).gradient((quality.sigmoid(of(v, start).times(part)) - y[~held]) / len(start)) + quality.L2 * np.append(part[:-1], 0)
                if given[v]:
                    own = of(v, list(given[v]))
                    g += own.gradient(quality.sigmoid(own.times(part)) - np.array(list(given[v].values()))) / len(given[v])
                out.append(g)
            return np.concatenate(out)

        now = np.split(quality.adam(gradient, np.concatenate(now), steps=quality.STEPS, rate=0.05, least=1e-6), [quality.WIDTHS[0] + 1])
    assert given[1], "the text view gave labels"
    total = -math.log(share / (1 - share))
    for v in (0, 1):
        slope, shift = quality.calibrated(of(v, test).times(now[v]), y[held])
        total = total + slope * of(v, range(len(rows))).times(now[v]) + shift
    for r in quality.graded(docs, labels, ["doc_id"]).collect():
        assert r.quality == pytest.approx(1 / (1 + math.exp(-total[r.doc_id])), abs=1e-4)


def test_associated_features_count_rows_not_values(spark):
    rows = spark.createDataFrame([("x x x", 1)] * 5 + [("y", 0)] * 5, "text string, label int")
    assert list(features.associated(rows, toxicity.bag, least=5, chi2=1)) == [b"x"]


@pytest.mark.parametrize("name", ["op2_pii", "op6_decontamination", "op8_warc", "op9_topk"])
def test_sql_agrees(spark, name):
    from paperloom.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = queries.queries()[name](spark, sf)
    names = sorted(frame.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(r) for r in frame.select(names).collect()) == Counter(want)


def test_texts_with_very_many_spans(spark):
    n = 30_000
    row = spark.createDataFrame([(1, "é a@b.de x " * n), (2, "+1 (555) 010 0199, " * 2000)], "doc_id int, text string").repartition(2)
    found = {r.doc_id: r for r in pii.redacted(row).join(pii.find_pii(row).select("doc_id", F.size("pii").alias("n"), F.element_at("pii", -1).alias("last")), "doc_id").collect()}
    assert found[1].n == n and (found[1].last.start, found[1].last.end) == (11 * n - 9, 11 * n - 3) and found[1].text == "é [EMAIL] x " * n
    assert found[2].n == 2000 and found[2].text == "[PHONE], " * 2000
