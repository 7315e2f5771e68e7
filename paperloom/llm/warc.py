"""Operator 8: WARC archives and their index, merged from sorted runs.

Archives are written and read with Spark's own text source, so they can lie in any
store that Spark reaches. A record starts with the version line and a WARC-Filename
field whose value is drawn anew for each run; that pair parts the records when they
are read in parallel, whatever the payloads hold. Equal payloads are stored once:
the record of the largest page_id is the response, all others are revisits of it. Only
digests are grouped. The response of a frequent payload is known to every task, so its
copies never travel; other payloads meet their digest, which few rows share. A revisit
states the length and digest of the full payload itself and needs no join when it is read.

The index lists the captures by URL key and time. Each task sorts its captures into a
run and cuts it into small blocks, at the bounds of the key ranges too. Blocks go to the
task of their range in the order of their first keys, so that a merge reads each run block
by block, only when it is needed: a loser tree merges what the runs hold below the first
key that was not read yet. A task holds about a block of each run, whatever the range.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, shared_dir, shuffle_partitions, staged, table, with_row

RECORDS_PER_FILE = 20_000
BLOCK = 64  # captures that travel together
HOT = 1 << 16  # payloads with at least this part of all rows are frequent: there are no more than this many
PENDING = 8_192  # captures that are read before a part of them is merged
BOUND_ROWS = 64  # sampled keys for each range of the index: they only balance the work
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_B32HEX, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    hexed = F.sha1(data)
    eight = lambda i: F.lpad(F.conv(F.substr(hexed, F.lit(10 * i + 1), F.lit(10)), 16, 32), 8, "0")
    return F.translate(F.concat(*[eight(i) for i in range(4)]), _B32HEX, _B32)


def url_key(url: Column) -> Column:
    """Sort-friendly URL: host parts reversed, then port, path and query, lower case."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_replace(F.regexp_extract(bare, "^([^/?#:]*)", 1), "^www[0-9]*\\.", "")
    rest = F.regexp_extract(bare, "^[^/?#:]*(:[0-9]+)?([^#]*)", 2)
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]", " "), F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, run: str) -> None:
    """A record for each row of pages (page_id, url, html); html null counts as empty.
    Of equal payloads, by length and SHA-256, the row of the largest page_id holds it;
    if that id repeats, one of its rows does. A null page_id is the smallest."""
    rows = with_row(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")))
    payload = F.col("html").cast("binary")
    rows = rows.withColumns({"size": F.octet_length("html"), "key": F.sha2(payload, 256), "sha1": base32_sha1(payload)})
    each = rows.groupBy("key", "size", "page_id").agg(F.max(ROW).alias("last"), F.count("*").alias("n"))
    holders = staged(each.groupBy("key", "size").agg(F.max(F.struct("page_id", "last", "n")).alias("holder"), F.sum("n").alias("copies")), "holders")
    total = holders.agg(F.sum("copies")).first()[0] or 0
    hot = holders.filter((F.col("copies") > 1) & (F.col("copies") * HOT >= total)).select("key", "size", F.col("holder").alias("hot"))  # at most HOT rows
    holds = lambda h: F.col("page_id").eqNullSafe(h["page_id"]) & ((h["n"] == 1) | (F.col(ROW) == h["last"]))
    known = F.col("hot").isNotNull()
    rows = rows.join(F.broadcast(hot), ["key", "size"], "left").withColumn("html", F.when(known & ~holds(F.col("hot")), "").otherwise(F.col("html")))
    digest = lambda: F.concat_ws(":", "key", "size")
    rows = rows.withColumn("meets", F.when(known, F.concat(F.lit("-"), F.col(ROW).cast("string"))).otherwise(digest()))
    rows = rows.join(holders.select(digest().alias("meets"), "holder"), "meets", "left").withColumn("holder", F.coalesce("hot", "holder"))
    own = holds(F.col("holder"))
    name = lambda page, *more: F.concat(F.lit("<urn:x-capture:"), F.coalesce(page.cast("string"), F.lit("")), F.lit("-"), F.col("sha1"), *more, F.lit(">"))
    taken = F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) % 1_000_000_000 + 1_704_067_200), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.concat(F.lit(HTTP), _field("Content-Length", F.col("size").cast("string")), F.lit("\r\n"), F.when(own, F.col("html")).otherwise(""))
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Filename: {run}.warc\r\n"),
        _field("WARC-Type", F.when(own, "response").otherwise("revisit")),
        _field("WARC-Record-ID", F.when(own, name(F.col("page_id"))).otherwise(name(F.col("page_id"), F.lit("-"), F.col(ROW).cast("string")))),
        _field("WARC-Target-URI", F.coalesce("url", F.lit(""))),
        _field("WARC-Date", taken),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(own, "").otherwise(F.concat(_field("WARC-Refers-To", name(F.col("holder.page_id"))), _field("WARC-Profile", F.lit(PROFILE)))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _field("Content-Length", F.octet_length("__pl_block").cast("string")),
        F.lit("\r\n"),
    )
    records = rows.withColumn("__pl_block", block).select(F.concat(head, F.col("__pl_block"), F.lit("\r\n")).alias("value"))
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_archives(spark: SparkSession, path: str, run: str) -> DataFrame:
    """record_id, record_type, url, taken, refers_to (a record id), digest and length of the
    full payload (as stated), payload (binary; empty in a revisit) of each record."""
    raw = spark.read.option("lineSep", f"WARC/1.1\r\nWARC-Filename: {run}.warc\r\n").text(path).filter(F.length("value") > 0)
    head = F.substring_index("value", "\r\n\r\n", 1)
    field = lambda name, of="head": F.regexp_extract(F.concat(F.lit("\n"), F.col(of)), f"\n{name}: ([^\r\n]*)", 1)
    parts = raw.withColumn("head", head).withColumn("rest", F.substr("value", F.length("head") + 5)).withColumn("http", F.substring_index("rest", "\r\n\r\n", 1))
    skip = F.octet_length("http") + 4
    payload = F.substr(F.col("rest").cast("binary"), skip + 1, field("Content-Length").cast("int") - skip)
    return parts.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("url"), field("WARC-Date").alias("taken"),
        F.nullif(field("WARC-Refers-To"), F.lit("")).alias("refers_to"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        field("Content-Length", "http").cast("bigint").alias("length"), payload.alias("payload"),
    )


def captures(records: DataFrame) -> DataFrame:
    """url_key, taken, page_id, record_type, refers_to (page_id), payload_bytes and
    payload_digest, both of the full payload: measured in a response, as stated in a revisit
    (broken() tells whether a revisit states what its response holds)."""
    page = lambda c: F.regexp_extract(c, "^<urn:x-capture:(-?[0-9]*)-", 1)
    number = lambda c: F.nullif(page(c), F.lit("")).cast("bigint")
    whole = F.col("record_type") == "response"
    n, digest = F.when(whole, F.octet_length("payload")).otherwise(F.col("length")), F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.col("digest"))
    return records.select(url_key(F.col("url")).alias("url_key"), "taken", number("record_id").alias("page_id"), "record_type", number("refers_to").alias("refers_to"), n.cast("bigint").alias("payload_bytes"), digest.alias("payload_digest"))


def broken(records: DataFrame) -> DataFrame:
    """record_id and reason of what does not hold together: responses whose payload is not
    what they state, and what revisits refer to and nobody has, or has otherwise. Revisits
    that state the same count once, before the shuffle, so a hot response is one row."""
    stored = records.filter("record_type = 'response'").select("record_id", "digest", "length", (F.octet_length("payload") == F.col("length")).alias("whole"), (base32_sha1(F.col("payload")) == F.col("digest")).alias("same"))
    bad = stored.filter(~(F.col("whole") & F.col("same"))).select("record_id", F.lit("payload differs from its record").alias("reason"))
    asked = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("record_id"), F.col("digest").alias("d"), F.col("length").alias("l")).distinct()
    met = asked.join(stored, "record_id", "left").filter(F.col("digest").isNull() | (F.col("digest") != F.col("d")) | (F.col("length") != F.col("l")))
    return bad.unionByName(met.select("record_id", F.when(F.col("digest").isNull(), "no such response").otherwise("revisits state another payload").alias("reason")))


class LoserTree:
    """Merges sorted iterators. Each inner node keeps the loser of its match; after the
    overall winner moved on, only the matches on its path are played again."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield winner, self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


SORTED_BY = ["url_key", "taken", "page_id"]


LOW = -(1 << 63)  # stands for a null page: it comes first


def _keys(part) -> list[tuple]:
    url, taken, page = (part.column(c).to_pylist() for c in SORTED_BY)
    return [(u.encode(), t, LOW if p is None else p) for u, t, p in zip(url, taken, page, strict=True)]


def _blocks(bounds: list[tuple]):
    """Of a sorted run: its blocks, with the range and the first key of each."""

    def run(batches):
        run_id, out = TaskContext.get().partitionId(), []
        for batch in batches:
            keys = _keys(batch)
            cuts = sorted({*range(0, batch.num_rows, BLOCK), *(bisect_left(keys, b) for b in bounds)} - {batch.num_rows})
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch.slice(a, b - a))
                out.append((bisect_right(bounds, keys[a]), run_id, *(batch.column(c)[a].as_py() for c in SORTED_BY), sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["range", "run", *SORTED_BY, "block"])
            out = []

    return run


class _Runs:
    """What a merge has read and not yet given out: of each run its keys and rows in order."""

    def __init__(self):
        self.of: dict[int, list] = {}
        self.size = self.most = 0

    def add(self, run: int, part: pa.RecordBatch) -> None:
        self.of.setdefault(run, []).append((_keys(part), part))
        self.size += part.num_rows
        self.most = max(self.most, self.size)

    def below(self, key: tuple | None):
        """Gives out, merged, all rows below a key (all, if None)."""
        keys, parts, order = [], [], []
        for run, blocks in list(self.of.items()):
            own, rest = [], []
            for block_keys, part in blocks:
                cut = len(block_keys) if key is None else bisect_left(block_keys, key)
                if cut:
                    own += block_keys[:cut]
                    parts.append(part.slice(0, cut))
                if cut < len(block_keys):
                    rest.append((block_keys[cut:], part.slice(cut)))
            if own:
                keys.append(own)
            if rest:
                self.of[run] = rest
            else:
                del self.of[run]
        if not keys:
            return
        places, base = [], 0
        for own in keys:
            places.append(base)
            base += len(own)
        for run, _ in LoserTree(keys):
            order.append(places[run])
            places[run] += 1
        self.size -= base
        whole = pa.Table.from_batches(parts).combine_chunks()
        yield from whole.take(pa.array(order)).to_batches()


def _merged(batches):
    """Blocks of one range, by their first keys: all rows in order."""
    runs = _Runs()
    for batch in batches:
        firsts = _keys(batch)
        for i, run in enumerate(batch.column(batch.schema.get_field_index("run")).to_pylist()):
            if runs.size >= PENDING:
                yield from runs.below(firsts[i])
            with pa.ipc.open_stream(batch.column(batch.schema.get_field_index("block"))[i].as_py()) as reader:
                for part in reader:
                    runs.add(run, part)
    yield from runs.below(None)


def capture_index(found: DataFrame) -> DataFrame:
    """The rows of captures() in one global order by URL key, time and page: partition by
    partition, and within each. Equal URLs are split by time and page, so a hot URL is not
    one task. Equal keys keep the order of their runs."""
    spark, tasks = found.sparkSession, shuffle_partitions(found.sparkSession)
    runs = staged(found.sortWithinPartitions(*SORTED_BY), "captures")
    sample = runs.select(*SORTED_BY).orderBy(F.xxhash64(*SORTED_BY)).limit(BOUND_ROWS * tasks).orderBy(*SORTED_BY).toArrow()  # bounded
    keys = _keys(sample)
    bounds = sorted({keys[len(keys) * i // tasks] for i in range(1, tasks)}) if keys else []
    # files may be read in other pieces than they were written in: each piece is sorted again, which costs one look if it is in order
    cut = runs.sortWithinPartitions(*SORTED_BY).mapInArrow(_blocks(bounds), "range int, run int, url_key string, taken string, page_id bigint, block binary")
    dealt = cut.repartitionById(len(bounds) + 1, "range").sortWithinPartitions(*SORTED_BY, "run")
    return dealt.mapInArrow(_merged, found.schema)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in the shared folder, reads them back
    and returns the merged index: a row for each page.

    A null html is an empty payload, a null url an empty URI, a null page_id the smallest.
    Of equal payloads, empty ones too, the largest page_id is the response; if that id
    repeats with the payload, one of its rows is. Payloads of any length are stored whole.
    Extra columns are ignored, whatever their names. Empty tables give an empty index."""
    spark, run = pages.sparkSession, uuid.uuid4().hex
    path = f"{shared_dir(spark)}/paperloom/warc-{run}"
    write_archives(pages, path, run)
    return capture_index(captures(read_archives(spark, path, run)))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS t FROM pages),
w AS (SELECT *, sha1(t) AS h, first_value(page_id) OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST, r DESC) AS top, row_number() OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST, r DESC) AS place FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('{_B32}', CAST((CAST('0x' || substr(h, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT) + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN top END AS refers_to
FROM w
"""
