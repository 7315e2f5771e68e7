"""The manifest, the mix of sources and the draw towards a target, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("paperloom.llm")

from paperloom.llm import common, merkle, mixing, resampling  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WIDE = [(None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5), (1, None, None, None, None), (2, "", "é", "b", 0), (2, "", "é", "b", 0), (2, "other", "é", "b", None), (3, "x" * 100_000, "en", "a", 2**63 - 1), (4, " \t\n", None, "c", 3)]


def rows_of(n, rnd):
    return [(i, " ".join(rnd.choice(["tea", "Cup", "día", "x1"]) for _ in range(rnd.randrange(60))), rnd.choice(["en", "en", "en", "de", None]), rnd.choice("aaabc"), i) for i in range(10, n + 10)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("clash"), "size": F.lit("clash"), "rank": F.lit(1), "__pl_place": F.lit(2)})


def same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = query(spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    return Counter(map(tuple, got.select(columns).collect())) == Counter(want) and bool(want)


def test_queries_equal_sql(spark):
    for query, module in ((merkle.op11_merkle, merkle), (mixing.op12_mixing, mixing), (resampling.op13_resampling, resampling)):
        assert same(spark, query, module.ORACLE_SQL), module.__name__


def test_prefix_sums(spark):
    rows = spark.createDataFrame([(g, i % 7, i) for i, g in enumerate("a" * 300 + "b" * 20 + "c")], "g string, k int, v int")
    for partitions in (1, 5):
        got = common.prefix_sums(rows.repartition(partitions), ["g"], ["k", "v"], F.col("v")).collect()
        assert len(got) == 321
        for r in got:
            assert r[common.BEFORE] == sum(x.v for x in got if x.g == r.g and (x.k, x.v) < (r.k, r.v))


def plain_manifest(rows, arity):
    """(doc_id, leaf) to all of (subroot, root, siblings) by lists of whole levels."""
    sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(r[1]))

    def tree(nodes):
        paths, now = [[] for _ in nodes], list(enumerate(nodes))  # (which leaves stand under a node is told by its place)
        level, width = [n for _, n in now], 1
        while len(level) > 1:
            for i in range(len(nodes)):
                own = i // width
                run = range(own - own % arity, min(len(level), own - own % arity + arity))
                paths[i].append(("".join(level[j] for j in run if j < own), "".join(level[j] for j in run if j > own)))
            level, width = [sha(*level[j : j + arity]) for j in range(0, len(level), arity)], width * arity
        return level[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: (sorted(((r[0] is not None, r[0] or 0, leaf(r)) for r in groups[g]))) for g in order}
    trees = {g: tree([x[2] for x in tops[g]]) for g in order}
    root, up = tree([trees[g][0] for g in order])
    return Counter((x[1] if x[0] else None, x[2], trees[g][0], root, tuple(path + above)) for g, above in zip(order, up, strict=True) for x, path in zip(tops[g], trees[g][1], strict=True))


@pytest.mark.parametrize("arity,height,n", [(2, 10, 40), (2, 1, 37), (3, 2, 100), (2, 2, 0), (4, 1, 1)])
def test_manifest_equals_a_plain_tree(spark, arity, height, n):
    rows = rows_of(n, random.Random(n)) + (WIDE if n != 1 else [])
    got = merkle.manifest(frame(spark, rows).repartition(3), merkle.leaf_of(*map(F.col, merkle.FIELDS)), arity=arity, height=height).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in got) == plain_manifest(rows, arity)


def test_manifest_of_nothing_and_folding(spark):
    leaf = merkle.leaf_of(*map(F.col, merkle.FIELDS))
    assert merkle.manifest(frame(spark, []), leaf).count() == 0
    docs = frame(spark, WIDE + rows_of(30, random.Random(9)))
    found = merkle.manifest(docs, leaf, carry={"other": F.lit("f" * 64)}, height=2)
    row = found.select(F.min(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")), F.max(merkle.folded(F.col("other"), F.col("proof")) == F.col("root"))).first()
    assert tuple(row) == (True, False)


def test_tampered_rows_are_found_out(spark):
    rows = merkle.op11_merkle(spark, SF).collect()
    docs = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and len({r.root for r in rows}) == 1
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or docs[r.doc_id] is None) == (r.folded_root == r.root)


def plain_mix(rows, weights=(5, 2, 1), most=3, weight=None):
    """doc_id and all columns of the mix by rounds of sharing out, with exact fractions."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    have = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, free, target = Fraction(sum(have.values())), list(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * have[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = Fraction(most * have[s])
            left -= target[s]
            free.remove(s)
    out = []
    for s in names:
        words = math.floor(target[s] + Fraction(1, 2))
        epochs, rest = divmod(words, have[s]) if have[s] else (0, 0)

        def key(r):
            n = len(r[1] or "") / max(1, size(r[1]))
            u = (int(hashlib.sha256(f"paperloom:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            return (-math.log(u) / max(0.05, min(1.0, n / 4, 12 / max(n, 1.0))), r[0] is not None, r[0] or 0, size(r[1]))

        for r in sorted((r for r in rows if r[3] == s), key=key):
            part = max(0, min(size(r[1]), rest))
            rest -= size(r[1])
            out.append((r[0], size(r[1]), have[s], round(float(target[s]), 6), epochs, part, epochs * size(r[1]) + part))
    return Counter(out)


@pytest.mark.parametrize("n", [0, 1, 60, 300])
def test_mix_equals_a_plain_version(spark, n):
    rows = rows_of(n, random.Random(n)) + (WIDE if n else [])
    made = "doc_id size source_size target epochs part taken".split()
    got = mixing.mixed(frame(spark, rows).repartition(3), ["doc_id"]).collect()
    assert Counter((*[r[c] for c in made[:3]], round(r.target, 6), r.epochs, r.part, r.taken) for r in got) == plain_mix(rows)
    if n == 300:
        by = defaultdict(int)
        for r in got:
            by[(r.source_size, r.target)] += r.taken
            assert r.taken <= 3 * r.size
        assert all(abs(taken - target) <= 0.5 for (_, target), taken in by.items())
        again = mixing.mixed(frame(spark, rows).repartition(7, "text"), ["doc_id"]).collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_small_sources_give_three_epochs_and_better_documents_come_first(spark):
    rows = [(i, "word " * 10, "en", "a" if i < 5 else "b", 0) for i in range(400)]
    weight = F.when(F.col("doc_id") % 2 == 0, 20.0).otherwise(1.0)
    got = mixing.mixed(spark.createDataFrame(rows, DOCS), ["doc_id", "text"], weight=weight, weights=(1, 1))
    rows = got.collect()
    assert all(r.taken == 30 for r in rows if r.doc_id < 5)
    gone = [r.doc_id for r in rows if r.taken == 0]
    assert len(gone) == 10 and sum(i % 2 for i in gone) >= 9
    texts = mixing.copies(got).collect()
    assert sum(len(r.text.split()) for r in texts) == sum(r.taken for r in rows) and max(r.epoch for r in texts) == 3


def test_mix_stays_on_the_jvm(spark):
    plan = mixing.op12_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def plain_draw(rows, target, percent, least, runs=1, buckets=10_000, seed=2024):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    feats = lambda t: [zlib.crc32(b" ".join(w[i : i + k])) % buckets for w in [words(t)] for k in range(1, runs + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(b for r in rows for b in feats(r[1])), Counter(b for x in target for b in feats(x))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for r in rows:
        f = feats(r[1])
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for i, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = i + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("runs,percent,least,target", [(1, 10, 20, ["día día cup", None, ""]), (2, 50, 0, ["tea x1 tea x1"]), (1, 100, 1, []), (1, 0, 0, ["a"])])
def test_draw_equals_a_plain_version(spark, runs, percent, least, target):
    copies = [(None, "tea cup " * 15, "en", "a", 1)] * 40  # as many rows of one score
    rows = rows_of(200, random.Random(runs)) + WIDE + copies
    docs, goal = frame(spark, rows).repartition(3), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = resampling.resampled(docs, goal, runs=runs, percent=percent, least=least)
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == plain_draw(rows, target, percent, least, runs)


def test_draw_from_nothing(spark):
    assert resampling.resampled(frame(spark, []), spark.createDataFrame([], "text string")).count() == 0
