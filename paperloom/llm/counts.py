"""Operator 4: exact token counts by dynamic programming over prefixes.

Each pre-token gets a table: the exact number of tokens of every one of its prefixes, as a
word of its own. Pre-tokens that are new in a batch are taken in order, so that those with a
common beginning share that part of their tables, and workers remember tables of short ones.
The count of a text is the sum of their last entries, remembered for each short run without
white space. The table of a run joins those of its pre-tokens; that of a text, with a count for each prefix, answers truncation and
budget questions by looking up, without encoding again."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import END, PrefixTable
from .common import table, text_bytes, worker_state

CACHE_LIMIT = 600_000
CACHED_LENGTH = 64
SLICE = 16 << 20  # bytes of text whose new runs are worked on together
#: Signs whose normal form, lower case and class do not depend on a Unicode version.
_PLAIN = re.compile("[!-~¡-ɏ]+")


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level BPE for all 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordCounter:
    """Counts tokens as the tokenizers library does with a lower-casing word-end BPE
    file, without begin, end or added special tokens."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(file)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_str(file.decode())
        closed = lambda t: t[: -len(mark)] + END if t.endswith(mark) else t
        pairs = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs[closed(a), closed(b)] = i
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or "(?!)")
        tokens = [closed(t) for t in model["vocab"] if t not in set(self.special)]
        self.table = PrefixTable(tokens, lambda a, b: pairs.get((a, b)), end_of_word=True)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"])
        self.letters = _byte_letters()
        self.known, self.past = {}, {}  # tokens of runs: those used since the last turn, and in the one before
        self.known_parts, self.past_parts = {}, {}  # tables of pre-tokens, likewise
        self.tables: dict[str, bytes | list[int]] = {}  # tables of runs, if texts get theirs
        self.sigma = self._normal("ΑΣ")[1] != self._normal("ΑΣΑ")[1]  # a lower case that depends on what follows

    def _normal(self, raw: str) -> str:
        return unicodedata.normalize("NFC", raw).lower() if _PLAIN.fullmatch(raw) else self.library.normalizer.normalize_str(raw)

    def _pretokens(self, normal: str) -> list[tuple[int, str]]:
        """Pre-tokens of a run in its normal form, and where they start."""
        if _PLAIN.fullmatch(normal):
            return [(m.start(), m[0]) for m in self.words.finditer(normal)]
        return [(a, normal[a:b]) for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _words(self, raw: str) -> list[str]:
        """The pre-tokens of a section."""
        normal = self._normal(raw)
        if normal.isalpha() and _PLAIN.fullmatch(normal):
            return [normal]
        return [word for _, word in self._pretokens(normal)]

    def _letters(self, pretoken: str) -> str:
        if pretoken.isascii() and pretoken.isprintable() and " " not in pretoken:
            return pretoken
        return "".join(map(self.letters.__getitem__, pretoken.encode()))

    @staticmethod
    def _table(pretoken: str, closed: list[int]) -> bytes | list[int]:
        return _packed(closed[1:] if pretoken.isascii() else [closed[i] for i in accumulate(len(c.encode()) for c in pretoken)])

    def part(self, pretoken: str) -> bytes | list[int]:
        """The table of a pre-token: the count at each of its prefixes, from one sign on."""
        table = self.known_parts.get(pretoken)
        if table is None:
            table = self._table(pretoken, self.table.closed_counts(self._letters(pretoken)))
            if len(pretoken) <= CACHED_LENGTH:
                if len(self.known_parts) >= CACHE_LIMIT // 2:
                    self.known_parts, self.past_parts = {}, self.known_parts
                self.known_parts[pretoken] = table
        return table

    def _split(self, raw: str) -> tuple[int, list[str]]:
        """The special strings of a run, each one token, and the pre-tokens between them."""
        if "<|" not in raw:
            return 0, self._words(raw)
        found, at, words = 0, 0, []
        for m in self.cut.finditer(raw):
            words += self._words(raw[at : m.start()])
            found, at = found + 1, m.end()
        return found, words + self._words(raw[at:])

    def _total(self, raw: str) -> int:
        found, words = self._split(raw)
        return found + sum(self.part(word)[-1] for word in words)

    def run(self, raw: str) -> bytes | list[int]:
        """The table of a run of text without ASCII white space: special strings count one when
        they are whole, what is between them is a section."""
        out, done, at = [], 0, 0
        for m in [*(self.cut.finditer(raw) if "<|" in raw else ()), None]:
            end = m.start() if m else len(raw)
            section = _Section(self, raw[at:end])
            out += [done + n for n in section.prefixes()] if done else section.prefixes()
            if m:
                size = len(section.normal)
                out += [done + section.changed(size, self._normal(raw[end : end + k])) for k in range(1, len(m[0]))]
                done, at = done + section.before[-1] + 1, m.end()
                out.append(done)
        return _packed(out)

    def count(self, text: bytes) -> int:
        return self.counts([text])[0]

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text. Normalising, matching special tokens and splitting never look
        across white space, so runs are counted once and summed."""
        out, first, size = [], 0, 0
        for i, text in enumerate([*texts, None]):
            if text is None or size and size + len(text) > SLICE:
                long = self._learn(texts[first:i])
                out += [sum(map(self.known.__getitem__, t.split())) for t in texts[first:i]]
                for raw in long:
                    del self.known[raw]
                first, size = i, 0
            size += len(text or b"")
        return out

    def _learn(self, texts: list[bytes]) -> list[bytes]:
        """Make all runs of these texts known. Returns the long ones: they are seldom met again,
        so the caller forgets them."""
        if len(self.known) >= CACHE_LIMIT // 2:
            self.known, self.past = {}, self.known
        known, new = self.known, set()
        for text in texts:
            new.update(filterfalse(known.__contains__, text.split()))
        again = new & self.past.keys()
        known.update((raw, self.past[raw]) for raw in again)
        new -= again
        split = {raw: self._split(raw.decode()) for raw in new}
        tables = self._parts({word for _, words in split.values() for word in words})
        for raw, (found, words) in split.items():
            known[raw] = found + sum([tables[word][-1] for word in words])
        return [raw for raw in new if len(raw) > CACHED_LENGTH]

    def _parts(self, words: set[str]) -> dict[str, bytes | list[int]]:
        """The tables of pre-tokens; the new ones are made in order."""
        if len(self.known_parts) >= CACHE_LIMIT // 2:
            self.known_parts, self.past_parts = {}, self.known_parts
        tables = {word: table for word in words if (table := self.known_parts.get(word) or self.past_parts.get(word))}
        new = {self._letters(word): word for word in words if word not in tables}
        letters = sorted(new)
        for spelt, closed in zip(letters, self.table.closed_tables(letters), strict=True):
            tables[new[spelt]] = self._table(new[spelt], closed)
        self.known_parts.update((word, table) for word, table in tables.items() if len(word) <= CACHED_LENGTH)
        return tables

    def prefixes(self, text: str) -> np.ndarray:
        """The table of a text: for each i from 0 to its length the exact number of tokens
        of its first i code points."""
        out, total, end = np.zeros(len(text) + 1, np.int32), 0, 0
        for m in re.finditer(r"[^\x20\x09-\x0d]+", text):
            table = self.tables.get(m[0])
            if table is None:
                table = self.run(m[0])
                if len(table) <= CACHED_LENGTH:
                    if len(self.tables) >= CACHE_LIMIT:
                        self.tables.clear()
                    self.tables[m[0]] = table
            out[end + 1 : m.start() + 1] = total
            out[m.start() + 1 : m.end() + 1] = np.array(list(table), np.int32) + total
            total, end = int(out[m.end()]), m.end()
        out[end + 1 :] = total
        return out


def _chunks(text: str) -> list[str]:
    """Pieces whose normal forms do not depend on each other: a base sign and what joins it, or
    a run of white space (of Unicode; there is no other here)."""
    joins = lambda c: c > "\u02ff" and (unicodedata.combining(c) or unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff")
    starts = [i for i, c in enumerate(text) if not i or not (joins(c) or c.isspace() and text[i - 1].isspace())]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]


class _Section:
    """A run of text without white space and whole special strings: its normal form, its
    pre-tokens and the tokens before each. A cut leaves all pre-tokens but the last as they
    are, and the last has a table, unless the cut falls into a contraction or between signs that
    join (then the signs around it are split again, and the last tokens of the pre-token before it
    are enough to go on). So the work grows with the length, and with the number of
    signs that join one base."""

    def __init__(self, counter: WordCounter, raw: str):
        self.counter, self.raw, self.normal = counter, raw, counter._normal(raw)
        found = counter._pretokens(self.normal)
        self.starts, self.words, self.before = [a for a, _ in found], [w for _, w in found], [0]
        for word in self.words:
            self.before.append(self.before[-1] + counter.part(word)[-1])
        self.opened: tuple = (None,)

    def prefixes(self) -> list[int]:
        """The count of each prefix of the raw text, from one sign on."""
        raw, normal = self.raw, self.counter._normal
        if "Σ" in raw and self.counter.sigma:
            return [self.counter._total(raw[:i]) for i in range(1, len(raw) + 1)]
        if len(self.normal) == len(raw) and "İ" not in raw and (raw.isascii() or unicodedata.is_normalized("NFC", raw)):
            return self.plain()
        pieces = _chunks(raw)
        forms = [normal(piece) for piece in pieces]
        if "".join(forms) != self.normal:  # signs that a newer version of Unicode joins
            return [self.counter._total(raw[:i]) for i in range(1, len(raw) + 1)]
        out, c, whole = [], 0, self.plain()
        for piece, form in zip(pieces, forms, strict=True):
            out += [self.changed(c, normal(piece[:k])) for k in range(1, len(piece))]
            c += len(form)
            out.append(whole[c - 1] if c else 0)
        return out

    def plain(self) -> list[int]:
        """The count of each prefix of the normal form."""
        out, end = [], 0
        for start, word, total in zip(self.starts, self.words, self.before, strict=False):
            out += [total] * (start - end)
            table = self.counter.part(word)
            if word[0] == "'" and word[1:2].isalpha():
                table = [*(sum(self.counter.part(w)[-1] for _, w in self.counter._pretokens(word[:k])) for k in range(1, len(word))), table[-1]]
            out += [total + n for n in table] if total else table
            end = start + len(word)
        return out + [self.before[-1]] * (len(self.normal) - end)

    def changed(self, c: int, tail: str) -> int:
        """The count of the first c signs of the normal form and a tail that differs from what follows there."""
        k = bisect_right(self.starts, max(c - 3, 0)) - 1
        p, total = (self.starts[k], self.before[k]) if k >= 0 else (0, 0)
        q = c - CACHED_LENGTH
        while q > p and self.normal[q] == "'":  # a contraction could begin in the middle of a pre-token
            q -= 1
        if k < 0 or q <= p or c - p > len(self.words[k]):
            return total + sum(self.counter.part(word)[-1] for _, word in self.counter._pretokens(self.normal[p:c] + tail))
        (_, first), *found = self.counter._pretokens(self.normal[q:c] + tail)  # splits as it does from p on
        if self.opened[0] != k:
            word = self.counter._letters(self.words[k])
            self.opened = k, np.cumsum([0, *(len(sign.encode()) for sign in self.words[k])]), word, self.counter.table.opened(word)
        _, places, word, tables = self.opened
        total += self.counter.table.closed_after(word, tables, int(places[c - p]), self.counter._letters(first[c - q :]))
        return total + sum(self.counter.part(word)[-1] for _, word in found)


def _packed(counts: list[int]) -> bytes | list[int]:
    return bytes(counts) if max(counts, default=0) < 256 else list(counts)


def count_tokens(docs: DataFrame, file: bytes, limit: int = 2048, text: str = "text", prefix_table: bool = False) -> DataFrame:
    """docs without the text, with n_bytes, n_tokens, over_limit (n_tokens > limit)
    and, if asked for, `prefixes`: an array of the exact counts of the first 0, 1, 2, ...
    code points, which answers truncation and budget questions later (see tokens_at and
    truncated_at). One pass, no shuffle, whole texts of any length.

    Null and empty texts have 0 bytes and 0 tokens. Every row is returned once, repeated
    ids too. Columns of docs with the names of results are replaced, others stay. An
    empty table gives an empty result."""
    shipped, key = docs.sparkSession.sparkContext.broadcast(file), hashlib.sha256(file).hexdigest()
    results = ["n_bytes", "n_tokens", "over_limit", *["prefixes"] * prefix_table]
    kept = [c for c in docs.columns if c not in {*results, text}]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], text_bytes(f"`{text}`").alias("__pl_text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(True).alias("over_limit"), *[F.lit(None).cast("array<int>").alias("prefixes")] * prefix_table).schema

    def run(batches):
        counter = worker_state(("counts", key), lambda: WordCounter(shipped.value))
        for batch in batches:
            raws = [x.as_py() for x in batch.column(batch.num_columns - 1)]
            n = counter.counts(raws)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([len(x) for x in raws], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            if prefix_table:
                columns.append(pa.array([counter.prefixes(x.decode()) for x in raws], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *results])

    return source.mapInArrow(run, schema)


def tokens_at(prefixes, length):
    """Column: the tokens of the first `length` code points, from the stored table."""
    return F.get(prefixes, F.lit(length) if isinstance(length, int) else length)


def truncated_at(prefixes, budget: int):
    """Column: the most code points that a prefix of at most `budget` tokens has, from the
    stored table and without encoding again."""
    return F.array_max(F.transform(prefixes, lambda n, i: F.when(n <= budget, i)))


def tokenizer_bytes(name: str = "word_bpe_49k.json") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_bytes())
