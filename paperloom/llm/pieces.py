"""Operator 3: SentencePiece encoding and decoding by a merge-type prefix table."""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PrefixTable
from .common import table, worker_state

SPACE = "▁"
CACHE_LIMIT = 250_000  # words a worker remembers
CACHED_LENGTH = 64  # longer words are encoded each time


def _identity_normaliser(model: bytes) -> bool:
    return b"\n\x08identity\x12\x00" in model[-4096:]


class PieceEncoder:
    """Encodes as the sentencepiece library does with a BPE model that has byte
    fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if not _identity_normaliser(model):
            raise ValueError("only models with the identity normaliser are supported")
        n = sp.vocab_size()
        self.bytes = [0] * 256
        tokens, scores = {}, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                tokens[piece], scores[piece] = i, -sp.get_score(i)
        self.table = PrefixTable(tokens, lambda a, b: scores.get(a + b))
        # no piece joins another sign with a following space: words are independent
        if any(SPACE in t.lstrip(SPACE) for t in tokens):
            raise ValueError("the vocabulary has pieces over word boundaries")
        apart = "" if any("\n" in t for t in tokens) else "\n"
        self.words = re.compile(f"\n|{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+" if apart else f"{SPACE}+[^{SPACE}]*")
        self.tokens, self.begin, self.end = tokens, struct.pack("<I", sp.bos_id()), struct.pack("<I", sp.eos_id())
        self.known: dict[str, bytes] = {}

    def word_ids(self, word: str) -> bytes:
        ids = []
        for token in self.table.encode(word):
            i = self.tokens.get(token)
            if i is None:
                ids.extend(self.bytes[b] for b in token.encode())
            else:
                ids.append(i)
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        """All ids with begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.begin + self.end
        known, parts = self.known, [self.begin]
        for word in self.words.findall(SPACE + text.replace(" ", SPACE)):
            ids = known.get(word)
            if ids is None:
                ids = self.word_ids(word)
                if len(word) <= CACHED_LENGTH:
                    if len(known) >= CACHE_LIMIT:
                        known.clear()
                    known[word] = ids
            parts.append(ids)
        parts.append(self.end)
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        return self.library.decode(list(struct.unpack(f"<{len(packed) // 4}I", packed)))


def encode_decode(docs: DataFrame, model: bytes, text: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, `ids`
    (array of int) and `decoded`. One pass, no shuffle; whole texts.

    Null and empty texts give the begin and end ids and an empty decoded text.
    Columns of docs with the names of results are replaced; all others stay.
    An empty table gives an empty result."""
    spark = docs.sparkSession
    shipped, key = spark.sparkContext.broadcast(model), hashlib.sha256(model).hexdigest()
    new = [F.lit(None).cast(t).alias(n) for n, t in (("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"))]
    new += [F.lit(None).cast("array<int>").alias("ids")] * keep_ids + [F.lit(None).cast("string").alias("decoded")] * keep_text
    names = {"n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids, *["decoded"] * keep_text}
    kept = [c for c in docs.columns if c not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__pl_text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], *new).schema

    def run(batches):
        encoder = worker_state(("pieces", key), lambda: PieceEncoder(shipped.value))
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            texts = batch.column(batch.num_columns - 1)
            count, ids_hash, text_hash, ids, decoded = [], [], [], [], []
            for value in texts:
                packed = encoder.packed(value.as_py())
                back = encoder.decode(packed)
                count.append(len(packed) // 4)
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    ids.append(packed)
                if keep_text:
                    decoded.append(back)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if keep_ids:  # straight from the packed bytes, without a number object for each id
                ends = np.cumsum([0, *count], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            columns += [pa.array(decoded, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids, *["decoded"] * keep_text])

    return source.mapInArrow(run, schema)


def model_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, model_bytes()).drop("text")
