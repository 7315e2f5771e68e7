"""Documents and turns that arrive one by one. Compiling and checking keep no state, so the batch
operators serve unchanged. Answers of conversations are keyed state: latest_responses is an
aggregate that never ends, answers_until_idle forgets a conversation when it falls silent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from paperloom.operators import chat, documents
from paperloom.sources.sinks import shared_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_documents(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def compiled_stream(docs: DataFrame) -> DataFrame:
    return documents.compiled(docs)


def write_stream(docs: DataFrame, path: str, checkpoint: str):
    """Writes a stream to Parquet, each row once; runs until nothing new is there."""
    return docs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_responses(turns: DataFrame) -> DataFrame:
    """conv_id, turn, markdown of the last answer so far (complete or update mode)."""
    return chat.latest_response(turns)


def _later(a, b):
    """The later of two answers (turn, text), either may be None. A null turn is the earliest; of equal turns the larger text counts."""
    order = lambda x: (x is not None, *((x[0] is not None, x[0] or 0, x[1]) if x else ()))
    return max(a, b, key=order)


def _combined(batches):
    """Of each batch one row a conversation: its last time and its last answer, so that a hot
    conversation is a few rows when it is shuffled."""
    import pyarrow as pa

    for batch in batches:
        best: dict = {}
        for conv, at, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            last, answer = best.get(conv, (at, None))
            best[conv] = max(at, last), _later(answer, None if text is None else (turn, text))
        rows = [(conv, at, *(answer or (None, None))) for conv, (at, answer) in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(batch.schema)], schema=batch.schema)


class _Answers(StatefulProcessor):
    """State of a conversation: its last answer and when it counts as silent (one timer)."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("answer", "turn bigint, text string")
        self.until = handle.getValueState("until", "ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        before = tuple(self.kept.get()) if self.kept.exists() else None
        old = self.until.get()[0] if self.until.exists() else None
        now, until = before, old
        for r in rows:
            now = _later(now, None if r.text is None else (r.turn, r.text))
            until = max(until or 0, r.ms + self.idle_ms)
        if until != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(until)
            self.until.update((until,))
        if now != before:
            self.kept.update(now)
            yield Row(conv_id=key[0], turn=now[0], markdown=now[1], final=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.kept.exists():
            turn, text = self.kept.get()
            yield Row(conv_id=key[0], turn=turn, markdown=text, final=True)
        self.kept.clear()
        self.until.clear()

    def close(self) -> None:
        pass


def answers_until_idle(turns: DataFrame, at: str = "at", late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """conv_id, turn, markdown, final: a row whenever the last answer of a conversation changes
    (final false), and one when no turn came for idle_ms of event time (final true), after
    which its state is gone. turns: a stream of conv_id, turn, role, text and a time. Append mode.

    What is an answer, and which is the last, is as in chat.latest_response. Turns may come in
    any order and more than once: what does not change the answer gives no row. Turns later than
    the watermark, or without a time, are dropped; a conversation that goes on after its final
    row begins anew. Null conversations are one conversation."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    text = F.when((F.col("role") == "assistant") & (F.length(F.trim("text")) > 1), F.col("text"))
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col(at).cast("timestamp").alias("at"), F.col("turn").cast("bigint"), text.alias("text")).filter("at is not null")
    rows = rows.mapInArrow(_combined, rows.schema).withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return rows.groupBy("conv_id").transformWithState(_Answers(idle_ms), "conv_id bigint, turn bigint, markdown string, final boolean", "Append", "EventTime")


def answers_streamed(spark: SparkSession, path: str) -> DataFrame:
    """The last rows of answers_until_idle over stored turns (Parquet: conv_id, turn, role,
    text), read as a stream until all are read; a turn stands for a second."""
    one = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a file or a folder, a plain path only a folder
    turns = spark.readStream.schema("conv_id bigint, turn bigint, role string, text string").parquet(one)
    out, checkpoint = shared_path(spark, "answers"), shared_path(spark, "answers-state")
    write_stream(answers_until_idle(turns.withColumn("at", F.timestamp_seconds(F.coalesce("turn", F.lit(0))))), out, checkpoint).awaitTermination()
    found = spark.read.schema("conv_id bigint, turn bigint, markdown string, final boolean").parquet(out)
    return found.groupBy("conv_id").agg(F.max(F.struct("turn", "markdown")).alias("last")).select("conv_id", "last.turn", "last.markdown")
