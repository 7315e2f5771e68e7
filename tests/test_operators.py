"""Columns, operators, sources, sinks and streams on small tables, and queries against SQL."""

import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions import dialect, features
from paperloom.functions import text as tx
from paperloom.kernel import normalise, review
from paperloom.operators import audit, chat, documents, fidelity, receipts
from paperloom.plans import catalogue
from paperloom.sources import files, sinks
from paperloom.streaming import stream

SF = "/root/testdata/sf0.001"
TEXTS = [
    "", "# a\n\nb **c** ~~d~~ `e` [l](http://x.y)\n\n- i\n1. j\n", "```\n# no\n~~~\n```\n# yes", "~~~~\n~~~\nx\n~~~~\n", "```\nopen", "$$\nx\n$$\n$a$ and $$b$$ \\$5$", "> > q\n>\n> # h\n", "t\n===\n\nu\n---\n\n***\n- - -\n",
    "| a | b |\n|---|:-:|\n| 1 | 2 |\n", "א b — c‎ ה-R", "a\r\nb\x0bc\x1cd e\n", "﻿ \n", "x\0y", "$$\nodd", "__u__ **b", "   ```x\n``` y\nz", "-\n=\n\n---\na\n---",
]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("source", ["llm", " CommonMark "])
def test_feature_columns_equal_the_kernel(spark, source):
    for r in features.preflight(frame(spark), source=F.lit(source)).collect():
        want = review.preflight(TEXTS[r.doc_id], source)
        assert {k: r[f"f_{k}"] for k in want["features"]} == want["features"], TEXTS[r.doc_id]
        assert (r.valid, r.errors, r.sha256) == (want["valid"], want["errors"], want["sha256"])
    assert features.preflight(spark.createDataFrame([(1, None)], "doc_id int, text string")).first().errors == ["Markdown input is empty"]


def test_text_columns(spark):
    for r in frame(spark).select("doc_id", tx.folded(F.col("text")).alias("f"), tx.lines_of(F.col("text")).alias("l"), tx.dominant_rtl(F.col("text")).alias("d")).collect():
        assert (r.f, r.l) == (normalise.folded(TEXTS[r.doc_id]), TEXTS[r.doc_id].splitlines())
    row = spark.range(1).select(
        tx.safe_filename(F.lit(" My: File! ")).alias("a"), tx.safe_filename(F.lit("!")).alias("b"), tx.preview(F.lit("x" * 91)).alias("c"), tx.xml_escape(F.lit("<&\x01'\">")).alias("d"), tx.strong_direction(F.lit("א")).alias("e"),
        tx.fence_flags(F.split(F.lit("a\n```\nb\n```\nc"), "\n")).alias("f"), tx.unix_lines(F.lit("a \r\nb\r")).alias("g"), dialect.provider_label(F.lit("grok")).alias("h"), dialect.document_name(F.lit("x/Read.MD")).alias("i"),
        dialect.effective_profile(F.lit("auto"), F.lit("https://github.com/x")).alias("j"), tx.contains_ltr(F.lit("1a")).alias("k"),
    ).first()
    assert tuple(row) == ("my-file", "llm", "x" * 90 + "…", "&lt;&amp;&apos;&quot;&gt;", "rtl", [False, True, True, False, False], "a\nb\n", "Grok", "Read", "github", True)


def test_documents(spark):
    docs = frame(spark).withColumn("docx_sha256", F.lit("clash")).repartition(3)
    one, two = ({r.doc_id: (r.docx_sha256, bytes(r.docx)) for r in documents.compiled(docs).collect()} for _ in range(2))
    assert one == two and all(h == hashlib.sha256(b).hexdigest() for h, b in one.values())
    reports = documents.built(docs).cache()
    for r in reports.collect():
        before = review.preflight(TEXTS[r.doc_id])
        assert (r.docx is None) == (not r.valid) and r.valid <= before["valid"] and r.replay in (None, True) and r.features.asDict()["bytes"] == len(TEXTS[r.doc_id].encode())
    good, bad = documents.split_valid(reports)
    assert good.count() + bad.count() == len(TEXTS) and good.filter("not valid").isEmpty()
    verified = documents.verified(documents.compiled(docs)).filter("doc_id = 1").first()
    assert verified.valid and verified.fidelity.token_coverage == 1.0
    found = documents.nodes(docs.select("doc_id", "text"))
    assert found.filter("kind = 'document' and parent_id is null").count() == len(TEXTS) and found.filter("kind = 'heading'").count() > 3
    assert documents.parts(documents.compiled(docs.limit(1))).first().names[0] == "[Content_Types].xml"
    assert documents.package_report(documents.compiled(docs)).filter("not package.valid").isEmpty()
    assert documents.rich(docs.limit(0)).isEmpty() and documents.compiled(docs.limit(0)).isEmpty()
    reports.unpersist()


def test_fidelity(spark):
    pairs = [("a b b C", "b c c"), ("", "x"), (None, None), ("ß", "SS")]
    got = {r.k: tuple(r)[1:] for r in fidelity.fidelity(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, e string, a string"), "k", "e", "a").collect()}
    assert got == {0: (4, 2, 0.5), 1: (0, 0, 1.0), 2: (0, 0, 1.0), 3: (1, 0, 1.0)}


def test_fidelity_compares_rows_where_they_are(spark, monkeypatch):
    rows = [(1, "a b b C", "b c c"), (2, "", "x"), (None, "q q", "q"), (3, "z " * 3000 + "y", "z y y"), (4, "a b", None)]
    plan = fidelity.fidelity(spark.createDataFrame(rows, "k int, e string, a string"), "k", "e", "a")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan

    def compared(rows):
        return sorted(map(tuple, fidelity.fidelity(spark.createDataFrame(rows, "k int, e string, a string"), "k", "e", "a").collect()), key=str)

    again = [*rows, (1, "c d", "b"), (None, "q", "q q"), (5, "n", "m"), (5, None, "n")]
    found = compared(rows), compared(again)
    assert (1, 4, 2, 0.5) in found[0] and (3, 3001, 2999, 2 / 3001) in found[0] and (None, 2, 1, 0.5) in found[0]
    assert {r[:3] for r in found[1]} == {(1, 6, 2), (2, 0, 0), (None, 3, 0), (3, 3001, 2999), (4, 2, 2), (5, 1, 0)}
    monkeypatch.setattr(fidelity, "REPEATED", -1)
    assert (compared(rows), compared(again)) == found


def test_tokens_are_counted_in_their_rows(spark, monkeypatch):
    """Rows with keys of their own need no shuffle; repeated keys, few or many, are summed."""
    rows = [(1, "b a B ß ss c"), (2, None), (3, ""), (4, "--"), (None, "x y x"), (5, "Aé aÉ 1 1 ÄÖ"), (6, "z " * 3000)]
    plan = fidelity.token_counts(frame(spark, TEXTS), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan

    def counted(rows):
        found = fidelity.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
        assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("doc_id", "bigint"), ("token", "string"), ("n", "bigint")]
        return sorted(map(tuple, found.collect()), key=str)

    def wanted(rows):
        total = Counter()
        for key, text in rows:
            total.update((key, token) for token in "".join(c if c.isalnum() else " " for c in (text or "").lower().replace("ß", "ss")).split())
        return sorted(((*at, n) for at, n in total.items()), key=str)

    again = [*rows, (1, "a q"), (None, "x"), (5, None), (7, "new new")]
    assert counted(rows) == wanted(rows) and counted(again) == wanted(again) and counted([]) == []
    monkeypatch.setattr(fidelity, "REPEATED", 1)
    assert counted(again) == wanted(again)


def test_chat(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "first"), (1, 2, "assistant", " x "), (1, 3, "user", "later"), (2, 1, "assistant", "a"), (2, 1, "assistant", "bb")], "conv_id int, turn int, role string, text string")
    assert {tuple(r) for r in chat.latest_response(turns).collect()} == {(1, 1, "first"), (2, 1, "bb")}
    raw = ['x {"action": "insert_markdown", "markdown": "m"} y', '{"action": "no", "reply": "r"}', "plain", "{broken", '{"a": }', None]
    got = [tuple(r.a) for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(chat.parsed_action(F.col("raw")).alias("a")).collect()]
    assert got == [("insert_markdown", "m", ""), ("reply", "", "r"), ("reply", "", "plain"), ("reply", "", "{broken"), ("reply", "", '{"a": }'), ("reply", "", "")]
    pages = spark.createDataFrame([("chrome://x", "<p>a"), ("https://www.claude.ai/c", '<div data-testid="assistant-message"><b>hi</b></div>'), (None, None)], "url string, html string")
    assert {(r.ok, r.provider, r.markdown) for r in chat.captured(pages).collect()} == {(True, "claude", "**hi**"), (False, "generic", None)}
    e = spark.range(1).select(chat.envelope(F.lit(" a \n"), F.lit("grok"), F.lit("")).alias("e")).first().e
    assert (e.ok, e.markdown, e.provider_label, e.title) == (True, "a", "Grok", "LLM response")


def test_receipts(spark):
    base = {"docx_sha256": "d", "pdf_sha256": "p", "pages_expected": 2, "pages_rendered": 2, "pages_reviewed": 2, "reviewed_pages": [1, 2], "issues": [], "images": 2, "actual_docx_sha256": "d", "actual_pdf_sha256": "p"}
    changes = [{}, {"pages_expected": 0}, {"pages_rendered": 1}, {"pages_reviewed": None}, {"reviewed_pages": [2, 1]}, {"issues": ["x"]}, {"images": 3}, {"actual_docx_sha256": "e"}, {"pdf_sha256": None}]
    schema = receipts.RECEIPT + ", actual_docx_sha256 string, actual_pdf_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = spark.createDataFrame([tuple((base | c)[n] for n in names) for c in changes], schema)
    assert [r.visual_valid for r in receipts.visual_gate(rows).collect()] == [True] + [False] * 8
    md = spark.createDataFrame([("a/x.md", "[b](./y.md) [c](../z.md) [d](#e) [f](http://g) [h](no.md)"), ("a/y.md", ""), ("z.md", "BadTerm")], "path string, text string")
    assert [tuple(r) for r in audit.broken_links(md).collect()] == [("a/x.md", "no.md")] and receipts.banned_terms(md, ["badterm"]).first().path == "z.md"
    m = receipts.runtime_manifest(spark.createDataFrame([('{"schema_version":1,"engine":"paperloom","binaries":{"a":"h"}}',), ("nope",)], "value string"))
    assert [r.valid for r in m.collect()] == [True, False]
    assert [r.path for r in receipts.unlisted_binaries(spark.createDataFrame([("a", "h"), ("b", "h")], "path string, sha256 string"), m.filter("valid")).collect()] == ["b"]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "One.md").write_text("# x")
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "skip.rs").write_text("no")
    found = {r.name: r for r in files.markdown_files(spark, str(tmp_path / "in")).collect()}
    assert found["One"].text == "# x" and found["One"].valid and not found["bad"].valid and len(found) == 2
    reports = documents.built(frame(spark)).cache()
    sinks.write_checked(reports, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/valid")).count() + spark.read.parquet(str(tmp_path / "out/quarantine")).count() == len(TEXTS)
    sinks.write_reports(reports, str(tmp_path / "json"))
    sinks.write_texts(reports, str(tmp_path / "txt"))
    assert spark.read.json(str(tmp_path / "json")).count() == len(TEXTS)
    sinks.register(spark)
    reports.filter("docx is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("name"), "docx").write.format("paperloom_docx").mode("append").save(str(tmp_path / "docx"))
    back = files.packages(spark, str(tmp_path / "docx"))
    assert back.count() == reports.filter("docx is not null").count() and documents.package_report(back).filter("not package.valid").isEmpty()
    bundle = spark.createDataFrame([({"b": bytearray(b"2"), "a": bytearray(b"1")},)], "files map<string,binary>")
    one, two = (bytes(sinks.release(bundle).first().zip) for _ in range(2))
    assert one == two and sinks.release(bundle).first().sha256sums.split()[1::2] == ["a", "b"]
    reports.unpersist()


def test_commands(spark, tmp_path, capsys):
    import json

    from paperloom import commands

    def run(*args):
        code = commands.main([str(a) for a in args], spark)
        said = capsys.readouterr()
        return code, json.loads(said.out or said.err)

    source, out, report, text = (tmp_path / n for n in ("a.md", "out/a.docx", "r/report.json", "r/text.txt"))
    source.write_text("# T\n\nשלום **b**\n")
    assert run("doctor") == (0, run("doctor")[1]) and run("doctor")[1]["deterministic"]
    code, found = run("preflight", source)
    assert code == 0 and found["f_headings"] == 1 and found["sha256"]
    code, made = run("build", source, out, "--report", report, "--expected-input-sha256", found["sha256"].upper(), "--review-text", text)
    assert code == 0 and all(made["checks"].values()) and out.exists() and "שלום" in text.read_text() and json.loads(report.read_text())["command"] == "build"
    assert run("verify-run", source, out)[0] == 0 and run("review", source, out)[1]["command"] == "review" and run("validate", out)[0] == 0
    code, bad = run("build", source, out, "--expected-input-sha256", "0" * 64)
    assert code == 1 and not bad["checks"]["input_sha256_verified"] and not out.exists()
    source.write_text("```")
    assert run("build", source, out)[1]["checks"]["markdown_preflight"] is False
    (tmp_path / "b.docx").write_bytes(b"no")
    assert run("validate", tmp_path / "b.docx")[0] == 1 and run("preflight", tmp_path / "none.md")[0] == 1


def test_one_failing_document_leaves_the_others(spark):
    def work(text):
        if text == "bad":
            raise RuntimeError("no")
        return (len(text),)

    rows = documents._mapped(spark.createDataFrame([("a",), ("bad",), ("ccc",)], "text string"), [F.col("text")], "n int", work).collect()
    assert [(r.n, r.kernel_error) for r in rows] == [(1, None), (None, "RuntimeError: no"), (3, None)]


def test_preflight_folds_grow_with_the_lines(spark):
    lines = "\n".join(["a", "```", "b", "```"] * 5000 + ["~~~", "x"])
    row = features.preflight(spark.createDataFrame([(lines,), ("```\n````\n~~~\n```\nout\n",)], "text string")).collect()
    assert (row[0].f_fenced_code_blocks, row[0].f_lines, row[0].errors) == (5001, 20002, ["unclosed fenced code block"])
    assert (row[1].f_fenced_code_blocks, row[1].valid) == (2, False)


def test_preflight_of_random_marks_equals_the_kernel(spark):
    import random

    rnd = random.Random(5)
    marks = ["|", "---", ":--", "- ", "* ", "> ", "\n", "\n", "\n\n", " ", "a", "1. ", "$", "$", "\\", "$$", "[", "](", "x)", "![", ")", "`", "~~~", "```", "```\n", "#", "=", "===", "**", "_ ", "\t"]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randrange(40))) for _ in range(800)]
    for r in features.preflight(frame(spark, texts).repartition(4)).collect():
        want = review.preflight(texts[r.doc_id])["features"]
        assert {k: r[f"f_{k}"] for k in want} == want, texts[r.doc_id]


def test_preflight_survives_lines_of_a_megabyte(spark):
    n = 1_000_000
    lines = ["|---" * (n // 4), "* " * (n // 2), "> " * (n // 2), "$a " * (n // 3), "[" * n, "[a](b" * (n // 5), "- " * (n // 2), "_ " * (n // 2), "`a" * (n // 2), "a $$" * (n // 4), " " * n + "x"]
    rows = {r.doc_id: r for r in features.preflight(frame(spark, lines).repartition(4)).collect()}
    assert len(rows) == len(lines) and rows[0].f_tables == 1 and all(rows[i].f_thematic_breaks == 1 for i in (1, 6, 7)) and rows[3].f_math_expressions == 0 and rows[9].f_block_math == n // 8


def test_stream(spark, tmp_path):
    frame(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    docs = stream.read_documents(spark, str(tmp_path / "in"), "doc_id bigint, text string", 1)
    q = stream.write_stream(stream.compiled_stream(docs), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    want = {r.doc_id: r.docx_sha256 for r in documents.compiled(frame(spark)).collect()}
    assert {r.doc_id: r.docx_sha256 for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(want) and want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_plans_stay_on_the_jvm_and_prune(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    latest = plan(catalogue.latest_assistant_response(spark, SF))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)" in latest and latest.count("Exchange hashpartitioning") == 1
    for name in ("preflight_features", "token_fidelity", "clean_markdown", "normalize_text"):
        assert "Python" not in plan(catalogue.queries()[name](spark, SF)) and "InArrow" not in plan(catalogue.queries()[name](spark, SF))
    assert "html" not in plan(catalogue.capture_filterable_pages(spark, SF)).split("ReadSchema")[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
