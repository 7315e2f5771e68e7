"""Files of packages: what commits is there whole, what fails leaves nothing."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.sources import sinks

SCHEMA = "name string, docx binary"


def names(path):
    return sorted(p.name for p in path.iterdir()) if path.exists() else []


def rows(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def test_committed_files_replace_older_ones(spark, tmp_path):
    sinks.register(spark)
    out = tmp_path / "docx"
    for uri, text in ((str(out), b"one"), (out.as_uri(), b"two")):
        rows(spark, [(f"{i}.docx", text) for i in range(20)] + [("x/../y.docx", text)]).repartition(4).write.format("paperloom_docx").mode("append").save(uri)
        assert names(out) == sorted([f"{i}.docx" for i in range(20)] + ["y.docx"]) and {p.read_bytes() for p in out.iterdir()} == {text}
    rows(spark, []).write.format("paperloom_docx").mode("append").save(str(out))
    assert len(names(out)) == 21


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    sinks.register(spark)
    out = tmp_path / "docx"
    fails = F.udf(lambda i: b"x" if i < 19 else 1 / 0, T.BinaryType())
    bad = spark.range(20).repartition(4, "id").select(F.concat("id", F.lit(".docx")).alias("name"), fails("id").alias("docx"))
    for table in (bad, rows(spark, [("a.docx", b"a"), ("b.docx", None)]), rows(spark, [("..", b"a")])):
        with pytest.raises(Exception):  # noqa: B017
            table.write.format("paperloom_docx").mode("append").save(str(out))
        assert names(out) == []


def test_a_repeated_task_counts_once(tmp_path):
    writer = sinks._FileWriter(str(tmp_path))
    first, again = (writer.write(iter([{"name": "a", "docx": text}, {"name": "b", "docx": b"b"}])) for text in (b"lost", b"kept"))
    assert names(tmp_path) == [writer.staging] and first.folder != again.folder
    writer.commit([again, None])
    assert names(tmp_path) == ["a", "b"] and (tmp_path / "a").read_bytes() == b"kept"
    other = sinks._FileWriter(str(tmp_path))
    other.write(iter([{"name": "c", "docx": b"c"}]))
    other.abort([None])
    assert names(tmp_path) == ["a", "b"]


def test_streams_commit_batches(spark, tmp_path):
    sinks.register(spark)
    rows(spark, [(f"{i}.docx", b"x") for i in range(6)]).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (tmp_path / "out").mkdir()
    query = stream.writeStream.format("paperloom_docx").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert names(tmp_path / "out") == [f"{i}.docx" for i in range(6)]
