"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a word the last token of its encoding is unique: it is the
one vocabulary entry that ends there and is *compatible* with the last token of
the prefix before it. Two tokens are compatible if encoding their concatenation
gives just these two. So one pass over the matches of an Aho-Corasick automaton
fills a table of last tokens (and of token counts), and walking back from the
end recovers the ids. Compatibility is decided once a pair by running the merges
on the two tokens alone, and remembered.

Two kinds of merges: `piece` (a merge is allowed if the joined piece is in the
vocabulary; the best piece score goes first) and `pair` (a ranked list of pairs,
with an end-of-word mark on the last symbol). Ties go to the leftmost place.
"""

from __future__ import annotations

import heapq

import ahocorasick

PAIRS = 1_000_000  # of tokens that a worker remembers
END = ""  # stands for the end-of-word mark inside this module


class _State:
    """Where the automaton stands: the longest end of what it read that begins a vocabulary
    entry, and the entries that end there, the longest first."""

    __slots__ = ("text", "own", "after", "open", "closing")

    def __init__(self, text: str, bodies: tuple[dict, dict]):
        self.text, self.own, self.after = text, {}, {}
        self.open, self.closing = (tuple(found[text[i:]] for i in range(len(text)) if text[i:] in found) for found in bodies)


class PrefixTable:
    """Vocabulary, merge priorities and the memo of compatible pairs."""

    def __init__(self, tokens, rank, end_of_word: bool = False):
        """tokens: the token texts, the end-of-word mark written as END.
        rank(left, right): priority of that merge (smaller goes first) or None."""
        self.rank, self.end_of_word = rank, end_of_word
        self.open, self.closing = ahocorasick.Automaton(), ahocorasick.Automaton()
        self.memos, self.remembered = [], 0
        self.bodies: tuple[dict, dict] = {}, {}
        self.begun: set[str] = set()
        self.root = None
        for token in tokens:
            closed = end_of_word and token.endswith(END)
            body = token[:-1] if closed else token
            if body:  # each entry keeps the memo of the tokens that may stand before it
                self.memos.append({})
                self.bodies[closed][body] = entry = (len(body), token, self.memos[-1])
                (self.closing if closed else self.open).add_word(body, entry)
        self.open.make_automaton()
        self.closing.make_automaton()
        self.longest = max((len(t) for t in tokens), default=1)

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges on a short list of symbols: the definition of the encoding."""
        n = len(symbols)
        left, right, live = list(range(-1, n - 1)), list(range(1, n + 1)), symbols[:]
        heap = []
        for i in range(n - 1):
            if (r := self.rank(live[i], live[i + 1])) is not None:
                heap.append((r, i, live[i], live[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if live[i] else n
            if live[i] != a or j >= n or live[j] != b:
                continue
            live[i], live[j] = a + b, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                if (r := self.rank(live[i], live[right[j]])) is not None:
                    heapq.heappush(heap, (r, i, live[i], live[right[j]]))
            if left[i] >= 0 and (r := self.rank(live[left[i]], live[i])) is not None:
                heapq.heappush(heap, (r, left[i], live[left[i]], live[i]))
        return [x for x in live if x]

    @staticmethod
    def symbols(token: str) -> list[str]:
        return [*token[:-2], token[-2:]] if token.endswith(END) and len(token) > 1 else list(token)

    def _compatible(self, before: str, token: str, memo: dict[str, bool]) -> bool:
        """before may be empty: then the question is whether token encodes to itself.
        Each pair of vocabulary entries is remembered at most once; all memos together
        are emptied before they can outgrow a worker."""
        ok = not (before and self.rank(before, token) is not None) and self.merged(self.symbols(before) + self.symbols(token)) == ([before, token] if before else [token])
        if self.remembered >= PAIRS:
            for kept in self.memos:
                kept.clear()
            self.remembered = 0
        self.remembered += 1
        memo[before] = ok
        return ok

    def last_tokens(self, word: str) -> list[str]:
        """last[i]: the last token of the first i symbols, read as an open prefix
        (without end-of-word mark). A symbol that no vocabulary entry ends at is
        a token by itself."""
        last: list = [None] * (len(word) + 1)
        last[0] = ""
        for end, (size, token, memo) in self.open.iter(word):
            i = end + 1
            if last[i] is None:
                before = last[i - size]
                if before is None:
                    before = self._alone(word, i - size, last)
                ok = memo.get(before)
                if self._compatible(before, token, memo) if ok is None else ok:
                    last[i] = token
        if None in last:
            for i in range(1, len(last)):
                if last[i] is None:
                    last[i] = word[i - 1]
        return last

    @staticmethod
    def _alone(word: str, i: int, last: list) -> str:
        for k in range(i, 0, -1):
            if last[k] is not None:
                break
            last[k] = word[k - 1]
        return last[i]

    def encode(self, word: str) -> list[str]:
        """Tokens of a word without end-of-word mark, recovered backwards."""
        last = self.last_tokens(word)
        out, i = [], len(word)
        while i:
            token = last[i]
            out.append(token)
            i -= len(token)
        out.reverse()
        return out

    def closed_counts(self, word: str) -> list[int]:
        """count[i]: the exact number of tokens of the first i symbols as a word
        of its own, that is with the end-of-word mark on symbol i."""
        return next(self.closed_tables([word]))

    def closed_tables(self, words):
        """closed_counts() of each word. What a table holds for a prefix is the same in all words that
        begin with it, so words in order go on where they leave the one before."""
        if self.root is None:
            self.begun = {body[:i] for bodies in self.bodies for body in bodies for i in range(1, len(body) + 1)}
            self.root = _State("", self.bodies)
        states, last, count, closed, before_it = [self.root], [""], [0], [0], ""
        for word in words:
            at = 0
            for a, b in zip(before_it, word, strict=False):
                if a != b:
                    break
                at += 1
            before_it = word
            del states[at + 1 :], last[at + 1 :], count[at + 1 :], closed[at + 1 :]
            state = states[at]
            for symbol in word[at:]:
                at += 1
                state = state.after.get(symbol) or self._step(state, symbol)
                # a symbol that no vocabulary entry ends at is a token by itself
                ended = final = 1
                found = symbol
                for size, token, memo in state.open:
                    before = last[at - size]
                    ok = memo.get(before)
                    if self._compatible(before, token, memo) if ok is None else ok:
                        found, ended = token, size
                        break
                for size, token, memo in state.closing:
                    before = last[at - size]
                    ok = memo.get(before)
                    if self._compatible(before, token, memo) if ok is None else ok:
                        final = size
                        break
                states.append(state)
                last.append(found)
                closed.append(count[at - final] + 1)
                count.append(count[at - ended] + 1)
            yield closed[:]

    def _step(self, state: _State, symbol: str) -> _State:
        """The state after one more symbol. States are made when they are first met."""
        text = state.text + symbol
        while text and text not in self.begun:
            text = text[1:]
        found = self.root
        for i, c in enumerate(text, 1):  # one state for each text, kept at the end of its own path
            found = found.own.get(c) or found.own.setdefault(c, _State(text[:i], self.bodies))
        state.after[symbol] = found
        return found

    def opened(self, word: str) -> tuple[list[str], list[int]]:
        """The last token and the number of tokens of each open prefix."""
        last = self.last_tokens(word)
        count = [0] * len(last)
        for i in range(1, len(last)):
            count[i] = count[i - len(last[i])] + 1
        return last, count

    def closed_after(self, word: str, tables: tuple[list[str], list[int]], at: int, more: str) -> int:
        """The number of tokens of word[:at] + more as a word of its own, from the opened tables
        of word: only the last symbols are looked at, however long the word is."""
        base = max(0, at - self.longest)
        text, size_now = word[base:at] + more, at + len(more)
        last, count = tables[0][base : at + 1] + [None] * len(more), tables[1][base : at + 1]
        for end, (size, token, memo) in self.open.iter(text):
            i = end + 1
            if base + i > at and last[i] is None:
                before = last[i - size]
                if before is None:
                    before = self._alone(text, i - size, last)
                ok = memo.get(before)
                if self._compatible(before, token, memo) if ok is None else ok:
                    last[i] = token
        for i in range(len(count), len(text) + 1):
            last[i] = last[i] or text[i - 1]
            count.append(count[i - len(last[i])] + 1)
        for end, (size, token, memo) in self.closing.iter(text):
            i = end + 1
            if base + i == size_now:
                ok = memo.get(last[i - size])
                if self._compatible(last[i - size], token, memo) if ok is None else ok:
                    return count[i - size] + 1
        return count[-2] + 1 if len(count) > 1 else 0
