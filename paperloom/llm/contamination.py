"""Operator 6: passages shared with a benchmark, found by winnowing.

Both sides hash every run of K words and keep, in each window of W such hashes, the
smallest ones. Two equal passages of K + W - 1 words hold an equal window, so they
keep the same hash at the same place: no shared passage of that length is missed.
Each kept document hash that also occurs among the benchmark's is sent, with the
words around it, to a join on the hash; there it is extended word by word to the
windows of the item. Items with fewer words than a window are one window each and
are found by the hashes of all runs of their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, bit_filter, passes, staged, table, text_bytes, with_row, worker_state
from .shingles import WordHashes, sequence_hashes

WINDOW = 10  # words of a passage that counts
K = 5  # words in a hashed run
W = WINDOW - K + 1  # hashes in a window of the winnowing
FILTER_BITS = 27  # at most 2 ** so many in the filter that documents are tried against

_SPACED = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(_SPACED).split()


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the hashes that are the smallest of some window of w (all of equal ones)."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = hashes[:n]
    for i in range(1, w):
        low = np.minimum(low, hashes[i : i + n])
    keep = np.zeros(len(hashes), bool)
    for i in range(w):
        keep[i : i + n] |= hashes[i : i + n] == low
    return np.flatnonzero(keep)


def fingerprints(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes kept for passages of `length` words: winnowed runs of K words
    for whole windows, all runs for shorter items."""
    if length == WINDOW:
        hashes = sequence_hashes(words, K)
        at = winnowed(hashes, W)
        return at, hashes[at]
    hashes = sequence_hashes(words, length)
    return np.arange(len(hashes)), hashes


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _item_prints(batches):
    """Of each item: a row for each fingerprint, with the words around it."""
    hashes = worker_state(("words", 0), WordHashes)
    for batch in batches:
        out = {n: [] for n in ("item", "length", "hash", "before", "after")}
        for item, text in zip(batch.column(0), batch.column(1), strict=True):
            words = words_of(text.as_py())
            if words:
                length = min(len(words), WINDOW)
                at, found = fingerprints(hashes.of(words), length)
                back = WINDOW - K if length == WINDOW else 0
                for p, h in zip(at.tolist(), _signed(found).tolist(), strict=True):
                    out["item"].append(item.as_py())
                    out["length"].append(length)
                    out["hash"].append(h)
                    out["before"].append(b" ".join(words[max(0, p - back) : p]))
                    out["after"].append(b" ".join(words[p : p + length]))
        yield pa.RecordBatch.from_arrays([pa.array(out["item"], pa.string()), pa.array(out["length"], pa.int32()), pa.array(out["hash"], pa.int64()), pa.array(out["before"], pa.binary()), pa.array(out["after"], pa.binary())], names=list(out))


def _document_prints(shipped, lengths: list[int]):
    """A head row of each document (length null) and a row for each fingerprint that
    passes the filter, with the words around it."""

    def run(batches):
        hashes = worker_state(("words", 0), WordHashes)
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1)
            n_words, out = [], {n: [] for n in ("row", "length", "hash", "at", "before", "after")}
            for row, text in zip(rows, batch.column(2), strict=True):
                words = words_of(text.as_py())
                n_words.append(len(words))
                values = hashes.of(words)
                for length in lengths:
                    at, found = fingerprints(values, length)
                    hit = passes(shipped.value, found)
                    back = WINDOW - K if length == WINDOW else 0
                    for p, h in zip(at[hit].tolist(), _signed(found[hit]).tolist(), strict=True):
                        out["row"].append(row)
                        out["length"].append(length)
                        out["hash"].append(h)
                        out["at"].append(p)
                        out["before"].append(b" ".join(words[max(0, p - back) : p]))
                        out["after"].append(b" ".join(words[p : p + length]))
            n, m = len(rows), len(out["row"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows + out["row"], pa.int64()), pa.concat_arrays([ids, pa.nulls(m, ids.type)]), pa.array(n_words + [None] * m, pa.int64()), pa.array([None] * n + out["length"], pa.int32()), pa.array([None] * n + out["hash"], pa.int64()),
                 pa.array([None] * n + out["at"], pa.int32()), pa.array([None] * n + out["before"], pa.binary()), pa.array([None] * n + out["after"], pa.binary())],
                names=["row", "doc_id", "n_words", *list(out)[1:]],
            )

    return run


def _extended(batches):
    """Of joined fingerprints: the windows of the item that stand in the document, as
    runs of starts (first, last) at one alignment."""
    for batch in batches:
        out = {n: [] for n in ("row", "item", "first", "last")}
        columns = [batch.column(i).to_pylist() for i in range(8)]
        for row, at, length, before, after, item, item_before, item_after in zip(*columns, strict=True):
            a, b = after.split(), item_after.split()
            right = 0
            while right < min(len(a), len(b)) and a[right] == b[right]:
                right += 1
            a, b = before.split()[::-1], item_before.split()[::-1]
            left = 0
            while left < min(len(a), len(b)) and a[left] == b[left]:
                left += 1
            if left + right >= length:
                out["row"].append(row)
                out["item"].append(item)
                out["first"].append(at - left)
                out["last"].append(at + right)
        yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int64()), pa.array(out["item"], pa.string()), pa.array(out["first"], pa.int32()), pa.array(out["last"], pa.int32())], names=list(out))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", kind: str = "bigint") -> tuple[DataFrame, DataFrame]:
    """(heads, hits): heads has row, doc_id (the column `key`), n_words of each document
    row; hits has row, item, first and last (end exclusive) of each shared run of words of
    at least a window.

    A null text has no words. Repeated rows of either table count one by one. An item
    without an id is looked for like all others and has a null item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes().alias("text"))
    prints = staged(items.mapInArrow(_item_prints, "item string, length int, hash bigint, before binary, after binary"), "leak-items")
    lengths = [r[0] for r in prints.select("length").distinct().orderBy("length").collect()]  # at most WINDOW values
    shipped = spark.sparkContext.broadcast(bit_filter(prints.select("hash"), FILTER_BITS))
    source = with_row(docs.select(F.col(f"`{key}`").cast(kind).alias("doc_id"), text_bytes().alias("text"))).select(ROW, "doc_id", "text")
    found = staged(source.mapInArrow(_document_prints(shipped, lengths), f"row bigint, doc_id {kind}, n_words bigint, length int, hash bigint, at int, before binary, after binary"), "leak-prints")
    known = prints.select("length", "hash", F.col("before").alias("item_before"), F.col("after").alias("item_after"), "item").distinct()
    joined = found.filter("length is not null").join(known, ["length", "hash"]).select("row", "at", "length", "before", "after", "item", "item_before", "item_after")
    hits = joined.mapInArrow(_extended, "row bigint, item string, first int, last int").distinct()
    return found.filter("length is null").select("row", "doc_id", "n_words"), hits


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row.

    Rows that repeat a doc_id are kept one by one; extra columns are ignored, whatever
    their names; texts of any length are taken whole; an empty table gives an empty
    result, and without benchmark rows nothing is hit. An item without words has no
    window. One without an id counts for n_hit and contaminated, not among the items."""
    heads, hits = overlaps(docs, benchmark)
    spans = hits.groupBy("row", "first").agg(F.max("last").alias("last"))
    places = spans.select("row", F.explode(F.sequence("first", F.col("last") - 1)).alias("word")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    items = hits.filter("item is not null").select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    empty = F.array().cast("array<string>")
    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("doc_id", "n_words")]
    parts = (
        heads.select("row", "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"), F.lit(True).alias("head"))
        .unionByName(places.select("row", *nothing, "n_hit", F.lit(None).cast("array<string>").alias("items"), F.lit(False).alias("head")))
        .unionByName(items.select("row", *nothing, F.lit(0).cast("bigint").alias("n_hit"), "items", F.lit(False).alias("head")))
    )
    merged = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("n_hit").alias("n_hit"), F.max("items").alias("items"))
    items_ = F.coalesce("items", empty)
    return merged.select("doc_id", "n_words", "n_hit", F.size(items_).cast("bigint").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark passage; all columns stay. What counts is
    the text of a row: ids may be null or repeat, and a clean row stays whatever others
    share its id. Null and empty texts stay."""
    keyed = docs.withColumn("__pl_key", F.md5(text_bytes()))
    heads, hits = overlaps(keyed, benchmark, "__pl_key", "string")
    bad = heads.join(hits.select("row").distinct(), "row", "left_semi").select(F.col("doc_id").alias("__pl_key")).distinct()
    return keyed.join(bad, "__pl_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS m, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT r, i, dw.m AS m, item FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
p AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + m)) AS k FROM h) GROUP BY r),
s AS (SELECT r, count(DISTINCT item) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s.l, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.r = p.r LEFT JOIN s ON d.r = s.r
"""
