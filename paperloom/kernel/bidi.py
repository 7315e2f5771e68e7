"""Direction of mixed text."""

from __future__ import annotations

import re
import sys
import unicodedata

from . import values

_RTL = re.compile(f"[{values.RTL[0]}-{values.RTL[1]}]")

#: Categories that hold the letters, numerals and marks that count as alphabetic.
_ALPHABETIC = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl"}
_OTHERS = frozenset(["\u0345", *map(chr, range(0x24B6, 0x24EA))])


def is_rtl(c: str) -> bool:
    return values.RTL[0] <= c <= values.RTL[1]


def contains_rtl(text: str) -> bool:
    if text.isascii():
        return False
    for _ in range(4):  # a copy tells where signs beyond Latin are, a search would look at each sign
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError as e:
            if _RTL.search(text, e.start, e.end):
                return True
            text = text[e.end :]
    return _RTL.search(text) is not None


def is_alphabetic(c: str) -> bool:
    if c.isascii():
        return c.isalpha()
    return unicodedata.category(c) in _ALPHABETIC or c in _OTHERS


def _latin() -> str:
    """All alphabetic signs that are not right-to-left, as the inside of a character class."""
    signs = (c for c in map(chr, range(sys.maxunicode + 1)) if (c.isalpha() or (c.isnumeric() or c in _OTHERS) and is_alphabetic(c)) and not is_rtl(c))
    spans: list[list[int]] = []
    for i in map(ord, signs):
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)


#: Letters of the other direction, and stretches of strong signs of one direction.
_LTR = re.compile(f"[{_latin()}]")
_STRONG = re.compile(f"({_RTL.pattern}+)|{_LTR.pattern}+")


def letters(text: str) -> bool:
    """Whether a text has an alphabetic sign that is not right-to-left."""
    first = text[:1]
    return first.isascii() and first.isalpha() or _LTR.search(text) is not None


def strong(c: str) -> bool | None:
    """True for right-to-left signs, False for left-to-right letters, None for neutral ones."""
    return True if is_rtl(c) else False if is_alphabetic(c) else None


def dominant_rtl(text: str) -> bool:
    if not contains_rtl(text):
        return False
    ends = [(m.end() - m.start(), m[1] is not None) for m in _STRONG.finditer(text)]
    return sum(n for n, rtl in ends if rtl) > sum(n for n, rtl in ends if not rtl)


def last_strong(text: str) -> bool | None:
    return next((d for c in reversed(text) if (d := strong(c)) is not None), None)


def _first_opener(neutral: str) -> int | None:
    """The first opening mark that is not closed within the neutral stretch."""
    for i, c in enumerate(neutral):
        if c in values.OPENERS and (c not in values.CLOSERS or neutral.find(values.CLOSERS[c], i + 1) < 0):
            return i
    return None


def cut_of(neutral: str, now: bool, then: bool, base: bool) -> int:
    """How much of the neutral signs between two directions stays with the first.

    White space at a change belongs to the side of the paragraph's own direction, closing
    marks to what they close, and an unclosed opener to what follows."""
    opener = _first_opener(neutral)
    end = len(neutral) if opener is None else opener
    back_to_base = now != base and then == base
    return len(neutral[:end].rstrip()) if back_to_base else end


def segments(text: str, base: bool, fallback: bool) -> list[tuple[str, bool]]:
    """(stretch, right-to-left) pairs that together are the text. Leading and trailing
    neutral signs join their neighbour; a wholly neutral text takes the fallback."""
    if not contains_rtl(text):
        return [(text, False if letters(text) else fallback)] if text else []
    out, start, place, now = [], 0, 0, None  # place: end of the last strong sign
    for m in _STRONG.finditer(text):
        d = m[1] is not None
        if now is not None and d != now:
            cut = place + cut_of(text[place : m.start()], now, d, base)
            out.append((text[start:cut], now))
            start = cut
        now, place = d, m.end()
    if start < len(text):
        out.append((text[start:], fallback if now is None else now))
    return out


def is_nested_ascii_atom(text: str) -> bool:
    """ASCII without white space, with a letter or digit and a `[`, all brackets balanced
    and at least once nested."""
    if not text.isascii() or any(c.isspace() for c in text) or "[" not in text or not any(c.isalnum() for c in text):
        return False
    depth, waiting = 0, []
    for c in text:
        if c in "([{":
            waiting.append(values.CLOSERS[c])
            depth = max(depth, len(waiting))
        elif c in ")]}" and (not waiting or waiting.pop() != c):
            return False
    return depth > 1 and not waiting
