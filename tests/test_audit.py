"""The audit of files and manifests of tables against plain versions."""

import posixpath
import random

from pyspark.sql import functions as F

from paperloom.operators import audit, manifests

PNG = bytes.fromhex("89504E470D0A1A0A0000000D49484452")


def test_paths_resolve_as_in_a_file_system(spark):
    rnd = random.Random(1)
    paths = ["", ".", "a/..", "../a", "a/../../b", "a//b/./c"] + ["/".join(rnd.choice(["a", "b", "..", ".", ""]) for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    paths = [p.lstrip("/") for p in paths] + ["x/" * 20_000 + "../" * 20_000 + "y"]
    for r in spark.createDataFrame(list(enumerate(paths)), "i int, p string").select("i", audit.resolved(F.col("p")).alias("r")).collect():
        assert r.r == posixpath.normpath(paths[r.i]).removeprefix("."[: paths[r.i] in ("", ".") or posixpath.normpath(paths[r.i]) == "."]), paths[r.i]


def test_terms_overlap_and_lie_within_others(spark):
    terms = ["abc", "bcd", "b", "ABCDE", "c+", "x y"]
    texts = ["abcde", "zABCz", "bc+d", "X y", "", None, "a" * 100_000 + "bcd"]
    got = {r.i: r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", audit.terms_in(F.coalesce("x", F.lit("")), terms).alias("t")).collect()}
    assert got == {i: sorted(t.lower() for t in terms if t.lower() in (x or "").lower()) for i, x in enumerate(texts)}


def test_audit(spark):
    files = [
        ("a/x.md", "[b](./y.md#q) [c](../z.md) [d](#e) [f](http://g) [h](no.md) [h](no.md#a) ![i](no.png) [up](../../z.md) [dir](../a) [root](/z.md) [m](mailto:a@b)", None), ("a/y.md", "C:\\Users\\bob\\f and http://h/home/p/", None), ("z.md", "/home/me/x BadTerm", None),
        ("docs/o.PDF", None, None), ("r.zip", None, None), ("a/r.zip", None, None), ("i/ok.png", None, PNG + (1000).to_bytes(4) + (250).to_bytes(4)), ("i/small.png", None, PNG + (999).to_bytes(4) + (9000).to_bytes(4)), ("i/cut.png", None, PNG), ("i/none.png", None, None), ("note.txt", "badterm", None),
    ]
    expected = spark.createDataFrame([("i/ok.png",), ("i/gone.png",), ("i/gone.png",)], "path string")
    got = sorted((tuple(r) for r in audit.audit(spark.createDataFrame(files, audit.FILES), ["badterm"], expected).collect()), key=str)
    assert got == sorted(
        [("a/x.md", "broken_link", "no.md"), ("a/x.md", "broken_link", "../../z.md"), ("a/y.md", "machine_path", "C:\\Users\\bob"), ("z.md", "machine_path", "/home/me/"), ("z.md", "banned", "badterm"), ("docs/o.PDF", "generated", "pdf"), ("r.zip", "generated", "zip"),
         ("i/small.png", "image", "999x9000"), ("i/cut.png", "image", "no PNG"), ("i/none.png", "image", "no PNG"), ("i/gone.png", "missing", None), ("i/small.png", "unexpected", None), ("i/cut.png", "unexpected", None), ("i/none.png", "unexpected", None)], key=str,
    )
    assert audit.audit(spark.createDataFrame([], audit.FILES), ["x"]).isEmpty()


def test_manifests_read_only_what_changed(spark, tmp_path):
    rows = [(i, "t" * (i % 9)) for i in range(2000)] + [(1, "again"), (None, None)]
    new = [(i, t + "!" if i == 77 else t) for i, t in rows if i != 900] + [(5000, "")]
    for name, table in (("a", rows), ("b", new), ("c", rows[::-1])):
        manifests.write(manifests.manifest(spark.createDataFrame(table, "id int, t string").filter("id is not null"), F.col("id"), F.col("t")), str(tmp_path / name))
    a, b, c = (str(tmp_path / n) for n in "abc")
    assert {tuple(r) for r in manifests.compare(spark, a, b).collect()} == {("77", "changed"), ("900", "missing"), ("5000", "unexpected")}
    assert len(manifests.changed_spans(spark, a, b)) == 3 and manifests.changed_spans(spark, a, c) == [] and manifests.compare(spark, a, c).isEmpty()
    found = manifests.compare(spark, a, b)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(span") + plan.count("PartitionFilters: [span") >= 2
