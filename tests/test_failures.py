"""A document that a kernel fails on is told, never left out as if it had nothing."""

import pytest

from paperloom.kernel import tree
from paperloom.plans import catalogue


@pytest.fixture
def failing(spark, tmp_path, monkeypatch):
    """A folder with three documents, of which the tree of the second (by its source) cannot be made flat."""
    rows = [(1, "a *b*", "en", "web"), (2, "c", "en", "bad"), (3, None, "de", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = tree.flat

    def flat(root, full=True):
        if "bad" in tree.plain_text(root):
            raise RuntimeError("no")
        return made(root, full)

    monkeypatch.setattr(tree, "flat", flat)
    return str(tmp_path)


def test_md_nodes_tell_of_failures(spark, failing):
    found = catalogue.md_nodes(spark, failing).collect()
    assert [tuple(r) for r in found if r.doc_id == 2] == [(2, None, None, None, None, None, None, "RuntimeError: no")]
    assert {r.doc_id for r in found} == {1, 2, 3} and all(r.kernel_error is None and r.kind for r in found if r.doc_id != 2)


def test_md_node_summary_counts_failures(spark, failing):
    found = {(r.lang, r.kind): tuple(r)[2:] for r in catalogue.md_node_summary(spark, failing).collect()}
    assert found.pop(("en", None)) == (0, None, 1, "RuntimeError: no")
    assert found["en", "document"] == found["de", "document"] == (1, 0, 0, None) and all(n > 0 and failed == 0 for n, _, failed, _ in found.values())


def test_md_fixed_nodes_end_with_a_failure(spark, failing, monkeypatch):
    query = catalogue.md_fixed_nodes(spark, failing)
    with pytest.raises(Exception, match="no tree of document 2: RuntimeError: no"):
        query.collect()
    with pytest.raises(Exception, match="no tree of document 2: RuntimeError: no"):
        query.count()
    monkeypatch.undo()
    found = {(r.doc_id, r.kind): r.n for r in catalogue.md_fixed_nodes(spark, failing).collect()}
    assert found == {(i, kind): n for i in (1, 2, 3) for kind, n in catalogue.FIXED_NODES.items()}
