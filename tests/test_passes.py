"""What queries cost: passes, shuffles and steps, counted where results alone do not show them."""

import __spark_entry__
from paperloom.kernel import bidi, inlines, review
from paperloom.kernel.docx import compile_docx

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_prose_is_read_in_stretches(monkeypatch):
    """One node for a stretch without marks, whatever letters are in it; bare links still end it."""
    made = []
    add = inlines._Chain.add
    monkeypatch.setattr(inlines._Chain, "add", lambda self, node: made.append(node) or add(self, node))
    text = "If hay was wet. The whole of it! " * 500
    assert [n.literal for n in inlines.Inlines(text, {}, True, set()).parse()] == [text] and len(made) == 1
    found = inlines.Inlines("of whttp://x (http://a.b/c). www. www.d.e, ftp:// ftp://f", {}, True, set()).parse()
    assert [(n.kind, n.literal or n.attrs["url"]) for n in found] == [("text", "of whttp://x ("), ("link", "http://a.b/c"), ("text", "). www. "), ("link", "http://www.d.e"), ("text", ", ftp:// "), ("link", "ftp://f")]


def test_directions_are_found_by_stretches(monkeypatch):
    """No look at each sign, and the classes hold what strong() says."""
    for c in map(chr, range(0x3000)):
        assert (bidi.letters(c), bidi.contains_rtl(c)) == (bidi.strong(c) is False, bidi.strong(c) is True), c
    monkeypatch.setattr(bidi, "strong", None)
    assert bidi.segments("abc " * 100 + "שלום (x", False, True) == [("abc " * 100, False), ("שלום", True), (" (x", False)]
    assert bidi.dominant_rtl("שלום abc") and not bidi.dominant_rtl("שלום abcde")


def test_shared_parts_are_parsed_once(monkeypatch):
    """Trees of parts that packages share are kept, that of the document is not; each package
    has one table of it."""
    read, tables = [], []
    parse, init = review.ET.fromstring, review.Flat.__init__
    monkeypatch.setattr(review, "_KEPT", review._Kept())
    monkeypatch.setattr(review.ET, "fromstring", lambda data: read.append(data) or parse(data))
    monkeypatch.setattr(review.Flat, "__init__", lambda self, root: tables.append(root) or init(self, root))
    for i in range(3):
        package = review.Package(compile_docx(f"text {i}"))
        assert review.validate(package)["valid"] and review.semantics(package)["text"] == f"text {i}"
    assert len(read) == 7 + 3 and len(tables) == 3 + 1
    monkeypatch.setattr(review, "SHARED", 2)
    monkeypatch.setattr(review, "_KEPT", review._Kept())
    assert review.validate(review.Package(compile_docx("x")))["valid"] and len(review._KEPT) <= 2


def test_packages_are_checked_where_they_are_made(spark):
    assert plan(spark, "validate_docx").count("MapInArrow") == 1


def test_verify_run_moves_no_packages(spark):
    """Packages meet their texts in the row they are made in; a null id keeps its row."""
    shown = plan(spark, "verify_run")
    assert "Join" not in shown and shown.count("Exchange") <= 1


def test_read_packages_in_one_pass(spark):
    assert plan(spark, "read_packages").count("MapInArrow") == 1


def test_directions_are_counted_without_arrays_of_signs(spark):
    from paperloom.functions import text as tx

    shown = spark.sql("select 'x שלום 1é😀𐐀' t union all select '' union all select null").select(tx.rtl_count(tx.F.col("t")).alias("r"), tx.ltr_count(tx.F.col("t")).alias("l"))
    assert sorted(map(str, shown.collect())) == ["Row(r=0, l=0)", "Row(r=4, l=3)", "Row(r=None, l=None)"]
    assert "regexp_extract_all" not in plan(spark, "direction_stats").lower()


def test_preflight_is_made_once(monkeypatch):
    from paperloom.operators.documents import report_of

    text = "# a\n\nb **c**\n"
    before, data, tested = review.preflight(text), compile_docx(text), review.self_test(compile_docx)
    want = report_of(text, data, "llm", data, tested, None)
    monkeypatch.setattr(review, "features", None)
    assert want[0] and report_of(text, data, "llm", data, tested, None, before) == want


def test_packages_are_packed_as_by_the_library(monkeypatch):
    from paperloom.kernel import docx

    cases = [docx.parts_of(t) for t in ("", "# a\n\nשלום x", "y" * 50_000)] + [{}, {"a.xml": "é"}]
    want = [docx._packed_by_library(parts) for parts in cases]
    monkeypatch.setattr(docx.zipfile, "ZipFile", None)
    assert [docx.packed(parts) for parts in cases] == want


def test_texts_of_a_tree_are_read_once():
    package = review.Package(compile_docx("a שלום b\n\n| x | y |\n|---|---|\n| 1  \n2 | $z^2$ |\n\n\n> q **r**\n"))
    tree = package.flat(review.DOCUMENT)
    for tag in list(tree.rows):
        for signs in (review.RUN_SIGNS, review.PARAGRAPH_SIGNS):
            plain = [(i, "".join(review._STRIP.sub("", signs[n.tag] or n.text or "") for n in tree.nodes[i].iter() if n.tag in signs)) for i in tree.rows[tag]]
            assert tree.texts(tag, signs) == plain
    assert len(tree.read) == 2 and review.Flat(None).texts("x", review.RUN_SIGNS) == []


def test_only_what_is_asked_for_leaves_python(spark):
    from paperloom.operators import documents

    docs = spark.createDataFrame([(1, "a"), (2, "```")], "doc_id int, text string")
    found = documents.built(docs, only=["valid", "replay"])
    assert found.columns == ["doc_id", "text", "valid", "replay", "kernel_error"]
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == [(1, "a", True, True, None), (2, "```", False, None, None)]


def test_build_report_moves_no_packages(spark):
    assert "docx#" not in plan(spark, "build_report")


def test_nodes_leave_python_as_rows(spark):
    """No arrays of trees to take apart, and only the columns that are summed."""
    shown = plan(spark, "md_node_summary")
    assert "Generate" not in shown and "literal" not in shown


def test_equal_short_inputs_are_worked_on_once(spark):
    import uuid

    from paperloom.operators.documents import _mapped

    rows = spark.createDataFrame([("a",)] * 500 + [("b",), (None,), ("x" * 5000,), ("x" * 5000,)], "text string").coalesce(1)
    found = _mapped(rows, [rows.text], "made string", lambda _: (str(uuid.uuid4()),)).collect()
    assert len(found) == 504 and len({r.made for r in found if r.text == "a"}) == 1 and len({r.made for r in found}) == 5


def test_short_inlines_and_formulas_are_read_once(monkeypatch):
    """Where they depend on nothing else: not with link references or notes in the text."""
    from paperloom.kernel import latex, markdown
    from paperloom.kernel.tree import Kept, flat

    texts, read, formulas = [], [], []
    init, made = markdown.Inlines.__init__, latex.read
    monkeypatch.setattr(markdown.Inlines, "__init__", lambda self, text, *a: read.append(text) or init(self, text, *a))
    monkeypatch.setattr(latex, "read", lambda source: formulas.append(source) or made(source))
    for module in (markdown, latex):
        monkeypatch.setattr(module, "_KNOWN", Kept())
    for _ in range(2):
        texts.append(flat(markdown.parse("- same **b**\n- same **b**\n\n[r]\n")))
        assert latex.to_omml("x^2") != latex.to_mathml("x^2")
    assert texts[0] == texts[1] and read == ["same **b**", "[r]"] and formulas == ["x^2"] * 2
    assert [n.kind for n in markdown.parse("[r]\n\n[r]: /u\n").children[0].children] == ["link"]
    for _ in range(2):
        assert [n.attrs["name"] for n in markdown.parse("a ^[n]\n").children if n.kind == "footnote"] == ["note-1"]
    known = Kept()
    for i in range(Kept.MOST + 1):
        known.keep(i, i)
    assert list(known) == [Kept.MOST]


def test_rich_pages_leave_python_as_hashes(spark):
    """No text goes through Python only to be dropped, and no page leaves it to be hashed."""
    import hashlib

    from paperloom.kernel.richhtml import rich_html
    from paperloom.operators import documents

    shown = plan(spark, "rich_html")
    assert "sha2(" not in shown and "rich_html#" not in shown and "MapInArrow run(doc_id" in shown and "(doc_id#0L, text#" not in shown
    docs = spark.createDataFrame([(1, "# a é"), (2, "> שלום"), (3, None)], "doc_id int, text string")
    found = {r.doc_id: r for r in documents.rich(docs, only=["html_sha256", "html_length"], keep=["doc_id"]).collect()}
    for i, text in ((1, "# a é"), (2, "> שלום"), (3, "")):
        page = rich_html(text)
        assert tuple(found[i]) == (i, hashlib.sha256(page.encode()).hexdigest(), len(page), None)
    assert documents.rich(docs).columns == ["doc_id", "text", "rich_html", "kernel_error"]


def test_prose_lines_begin_no_block(monkeypatch):
    """Lines that begin with a letter outside of containers are not asked what they begin, and a
    page without right-to-left signs is not searched for directions."""
    from paperloom.kernel import markdown, richhtml

    asked = []
    start = markdown.Blocks._start
    monkeypatch.setattr(markdown.Blocks, "_start", lambda self, line, *a: asked.append(line.rest) or start(self, line, *a))
    monkeypatch.setattr(richhtml, "resolved", None)
    page = richhtml.rich_html("a\nb\n\nc\n- d\ne\n\nf")
    assert "a" not in asked and "b" not in asked and "c" not in asked and "- d" in asked
    assert page.count("<p dir=\"ltr\"") == 3 and "a<br />\nb</p>" in page and "d<br />\ne</li>" in page


def test_pages_go_through_python_once(spark):
    """The page to be captured is in Python's batches once, and does not come back."""
    from paperloom.operators import chat

    shown = plan(spark, "html_capture")
    assert "MapInArrow run(page_id" in shown and "sha2(" not in shown and "run(page_id#0L, url" not in shown and " markdown#" not in shown
    pages = spark.createDataFrame([("https://x.y/", "<article>é hi</article>"), ("https://x.y/", "<p>a</p>")], "url string, html string")
    found = chat.captured(pages, only=["markdown", "markdown_sha256", "markdown_length"], keep=[])
    assert found.columns == ["markdown", "markdown_sha256", "markdown_length", "kernel_error"]
    whole = found.select("markdown", "markdown_sha256", "markdown_length", tx_sha("markdown"), "kernel_error").collect()
    assert sorted(map(tuple, whole), key=str) == sorted([("é hi", whole_sha("é hi"), 4, whole_sha("é hi"), None), (None, None, None, None, None)], key=str)


def tx_sha(column):
    from pyspark.sql import functions as F

    return F.sha2(column, 256)


def whole_sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()
