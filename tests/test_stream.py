"""Answers of conversations as keyed state with a timer: order, repeats, lateness, restart."""

from collections import Counter
from datetime import datetime, timedelta, timezone

from paperloom.operators import chat
from paperloom.streaming import stream

SCHEMA = "conv_id bigint, turn bigint, role string, text string, at timestamp"
START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def arrive(spark, folder, rows):
    made = [(c, t, role, text, None if at is None else START + timedelta(seconds=at)) for c, t, role, text, at in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path):
    turns = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.write_stream(stream.answers_until_idle(turns, late="10 seconds", idle_ms=100_000), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    state = sum(o.numRowsTotal for o in query.lastProgress.stateOperators)
    return Counter(map(tuple, spark.read.schema("conv_id bigint, turn bigint, markdown string, final boolean").parquet(str(tmp_path / "out")).collect())), state


def test_answers_until_idle(spark, tmp_path):
    folder, a = str(tmp_path / "in"), "assistant"
    arrive(spark, folder, [(1, 1, a, "a1", 0), (1, 0, a, "a0", 0), (2, 5, a, "zz", 0), (3, 1, "user", "only asks", 0), (None, None, a, "no turn", 0), (1, 9, a, "no time", None), (1, 8, a, " x ", 1), (1, 8, a, None, 1)])
    arrive(spark, folder, [(1, 1, a, "a1", 20), (1, 3, a, "a3", 60), (1, 3, a, "a3", 60), (2, 5, a, "zy", 60)])
    arrive(spark, folder, [(1, 2, a, "a2", 70), (None, 2, a, "second", 70), (2, 6, "user", "more", 70)])
    changes = Counter({(1, 1, "a1", False): 1, (2, 5, "zz", False): 1, (None, None, "no turn", False): 1, (1, 3, "a3", False): 1, (None, 2, "second", False): 1})
    assert run(spark, tmp_path)[0] == changes
    # a restart from the checkpoint: states are still there, all but the new conversation fall silent
    arrive(spark, folder, [(1, 3, a, "a3", 80), (2, 5, a, "zz", 80)])
    arrive(spark, folder, [(4, 1, a, "a4", 10_000)])
    changes += Counter({(4, 1, "a4", False): 1})
    finals = Counter({(1, 3, "a3", True): 1, (2, 5, "zz", True): 1, (None, 2, "second", True): 1})
    run(spark, tmp_path)
    # too late for a conversation that is gone; its state is not made anew
    arrive(spark, folder, [(1, 7, a, "late", 90), (4, 2, "user", "go on", 10_050)])
    got, state = run(spark, tmp_path)
    assert got == changes + finals and 0 < state <= 4


def test_streamed_answers_equal_the_batch(spark, tmp_path):
    rows = [(i % 7 if i % 3 else 0, i % 11, "assistant" if i % 2 else "user", f"t{i % 5}", None) for i in range(500)]
    arrive(spark, str(tmp_path / "t"), rows)
    got = stream.answers_streamed(spark, str(tmp_path / "t"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, chat.latest_response(spark.read.parquet(str(tmp_path / "t"))).collect()))
