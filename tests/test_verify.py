"""verify_run: one pass, and cheaper looks at texts and packages that find the same."""

import gc
import random
from collections import Counter

import __spark_entry__
from pyspark.sql import functions as F

from paperloom.kernel import bidi, docx, review
from paperloom.kernel.docx import compile_docx
from paperloom.operators import documents

MARKS = ["|", "---", ":--", "- ", "* ", "> ", "\n", "\n", "\n\n", " ", "a", "wörd ", "ß", "µ", "²", "½", "1. ", "٣. ", "$", "$$", "[x] ", "`", "```\n", "#", "# ", "==", "**", "*", "_ ", "_", "\t", "\0", "שלום", "—", "☐", "⁦", "⁩", "‎", "\x0b", "\x1c", "&amp;", "İ", "\U0001f600"]


def texts(n: int = 3000):
    rnd = random.Random(3)
    return ["".join(rnd.choice(MARKS) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_verify_run_goes_through_python_once(spark):
    """Packages are checked where they are made, and what nobody reads stays in Python."""
    shown = __spark_entry__.queries()["verify_run"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert shown.count("MapInArrow") == 1 and "docx" not in shown and "fidelity" not in shown


def test_packages_verified_where_they_are_made(spark, monkeypatch):
    rows = [(1, "# a\n\nb", "# a\n\nb"), (2, "# a\n\nb", "# a\n\nc"), (3, "```", "```"), (4, "d", "bad")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, other string")
    apart = {r.doc_id: r for r in documents.verified(documents.compiled(docs, text="other").drop("kernel_error")).collect()}
    made = docx.compile_docx

    def compile_or_fail(markdown, *args):
        if markdown == "bad":
            raise RuntimeError("no")
        return made(markdown, *args)

    monkeypatch.setattr(docx, "compile_docx", compile_or_fail)
    found = {r.doc_id: r for r in documents.verified(docs, of="other", keep=["doc_id"]).collect()}
    assert [found[i].valid for i in (1, 2, 3)] == [True, False, False] and found[1].checks.deterministic_replay and not found[2].checks.deterministic_replay
    for i in (1, 2, 3):
        assert found[i].asDict(True) == {k: v for k, v in apart[i].asDict(True).items() if k in found[i].asDict()}
    assert found[4].kernel_error == "RuntimeError: no" and found[4].valid is None
    assert documents.verified(docs, of="other", only=["valid"], keep=["doc_id"]).filter(F.col("valid")).count() == 1


def test_documents_leave_no_rings():
    """What the parser made goes at once, without the collector."""
    text = "a **b *c* [d](u) ~~e~~** [f] `g` x@y.z\n\n- h ^[n *m*]\n\n| i | $j$ |\n|---|---|\n| ![k](v) | [[w]] |\n"
    compile_docx(text)
    gc.collect()
    gc.disable()
    try:
        for i in range(20):
            data = compile_docx(text + f"{i} *o*")
            review.all_checks(text, data, "llm", data)
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_own_packages_are_read_as_by_the_library(monkeypatch):
    good = compile_docx("# a שלום\n")
    with monkeypatch.context() as m:
        m.setattr(review.zipfile, "ZipFile", None)
        names, parts, errors = review.read_package(good)
    assert names == [*docx.parts_of("# a שלום\n")] and not errors and docx.packed({n: p.decode() for n, p in parts.items()}) == good
    rnd, ours, bad = random.Random(4), docx.unpacked, [b"", good[:-1], good + b"x", b"x" + good, docx.packed({}), docx._packed_by_library({"é": "x"}), docx._packed_by_library({"a": "", "b": "y"})]
    for _ in range(400):
        at = rnd.choice([rnd.randrange(len(good)), len(good) - 1 - rnd.randrange(600)])
        bad.append(good[:at] + bytes([rnd.randrange(256)]) + good[at + rnd.choice([0, 1, 1, 1]) :])

    def read(data):
        try:
            return review.read_package(data)
        except Exception as e:  # what the library does not catch stays as it is
            return repr(e)

    quick = [read(data) for data in bad]
    monkeypatch.setattr(review, "unpacked", lambda data: None)
    assert quick == [read(data) for data in bad] and ours(good) == read(good)[1]


def test_line_marks_and_tokens_are_found_as_by_patterns():
    for text in texts():
        want = text
        for pattern, left in review.LINE_MARKS:
            want = pattern.sub(left, want)
        assert review._unmarked(text) == want, text
        assert review.tokens(text) == Counter(review._TOKEN.findall(text.casefold())), text
        assert bidi.contains_rtl(text) == (bidi._RTL.search(text) is not None), text
        assert review._stripped(text) == review._STRIP.sub("", text)
        source = review.Source(text)
        for pattern in (review.P.HEADING, review.P.TABLE_RULE, review.P.LIST_ITEM):
            assert source.times("starts", pattern) == source.times("text", pattern), text


def test_values_are_looked_up_from_their_ends():
    xml = '<w:d xmlns:w="{}"><w:p><w:pPr/><w:pPr><w:jc/><w:jc w:val="x"/></w:pPr></w:p><w:p><w:q><w:pPr><w:jc w:val="y"/></w:pPr></w:q></w:p><w:jc w:val="z"/></w:d>'.format(review.values.W_NS)
    tree = review.Flat(review.ET.fromstring(xml))
    first, second = tree.rows[review._w("p")]
    assert (tree.value(first, "pPr", "jc"), tree.value(second, "pPr", "jc"), tree.value(tree.rows[review._w("q")][0], "pPr", "jc"), tree.value(0, "pPr", "jc")) == ("", None, "y", None)
    assert [tree.up[i] for i in range(len(tree.nodes))] == [-1, 0, 1, 1, 3, 3, 0, 6, 7, 8, 0] and tree.end == [11, 6, 3, 6, 5, 6, 10, 10, 10, 10, 11]
