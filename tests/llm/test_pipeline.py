"""The stages of the pipeline, and all of it against a plain version."""

import math
import re

import duckdb
import pytest

pytest.importorskip("paperloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        assert out.columns == columns, name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) <= before, name
        before, docs = len(ids), out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(ids) and all(len(r.ids) == r.n_tokens for r in last)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(ids)


def test_empty_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'x' AS score", "1 AS row").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0 and "score" in docs.columns, name


def test_awkward_rows_pass_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 100").orderBy("item_id").first().text
    a, b = "one clean text that nothing else in the table is like at all", "and another clean one that shares its id with the first of them"
    rows = [(None, a + " null id"), (None, item), (-1, a), (-1, b), (-2, None), (-3, ""), (-4, "x" * 200_000), (-5, a.upper()), (-6, item), (-6, b + " of six"), (-7, "mail me: q@w.er, please")]
    own = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], docs.schema).selectExpr("*", "'k' AS severity", "1 AS component_id", "2 AS __pl_row")
    some = docs.limit(50).selectExpr("*", "'k' AS severity", "1 AS component_id", "2 AS __pl_row").unionByName(own)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, some, SF)
        assert out.columns == some.columns, name
        left[name] = {(r.doc_id, r.text) for r in out.filter("doc_id < 0 or doc_id is null").collect()}
    assert left["toxicity"] == set(rows)
    assert left["near_duplicates"] == set(rows) - {(-1, a)}  # -5 is the smaller id of both
    assert left["decontamination"] == {r for r in rows if item not in (r[1] or "")}
    assert left["pii"] == {(i, "mail me: [EMAIL], please" if i == -7 else t) for i, t in rows}
    last = corpus_pipeline.STAGES[-1][1](spark, some, SF)
    assert last.count() == some.count() and last.filter("doc_id = -2").first().ids == [1, 2]


def test_run_equals_a_plain_version(spark):
    from test_llm import linked_pairs

    from paperloom.llm import pieces, pii, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))  # the fit has a plain version of its own
    amount = model.scorer()
    ids = sorted(i for i, t in texts.items() if sum(1 / (1 + math.exp(min(500, x - amount(t)))) for x in model.thresholds) < toxicity.REJECTED)

    top = {i: i for i in ids}
    for a, b in sorted(linked_pairs([texts[i] for i in ids])):
        x, y = top[ids[a]], top[ids[b]]
        top = {k: min(x, y) if v in (x, y) else v for k, v in top.items()}
    ids = [i for i in ids if top[i] == i]

    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        m = min(10, len(w))
        if m:
            windows.setdefault(m, set()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    hit = lambda w: any(tuple(w[i : i + m]) in found for m, found in windows.items() for i in range(len(w) - m + 1))
    ids = [i for i in ids if not hit(words(texts[i]))]

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    spans = dict(con.sql(f"SELECT doc_id, spans FROM ({pii.ORACLE_SQL})").fetchall())
    library = pieces.PieceEncoder(pieces.model_bytes()).library
    want = {}
    for i in ids:
        out, at = "", 0
        for kind, start, end in (x.split(":") for x in spans[i].split(",") if x):
            if int(start) >= at:
                out += texts[i][at : int(start)] + f"[{kind.upper()}]"
            at = max(at, int(end))
        want[i] = [1, *library.encode(out + texts[i][at:]), 2]
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) < len(texts)
