"""What happens to a Markdown text before it is parsed."""

from __future__ import annotations

import re

from . import values
from .bidi import contains_rtl

_MAQAF = re.compile("([\u0590-\u05ff])-(?=[A-Za-z])")
_DROP = re.compile(f"[{values.BIDI_CONTROLS}]")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_STEP = re.compile(r"\\.?|[`$→←]", re.S)
_SWAP = {"→": "←", "←": "→"}


def folded(text: str) -> str:
    """Hebrew hyphens before Latin letters become maqafs (by the original neighbours), then
    em dashes become hyphens and direction controls go."""
    if text.isascii():
        return text
    if contains_rtl(text):
        text = _MAQAF.sub("\\1\u05be", text)
    return _DROP.sub("", text.replace("—", "-"))


def _mirrored_line(line: str) -> str:
    code = math = False

    def step(m) -> str:
        nonlocal code, math
        c = m[0]
        if c == "`" and not math:
            code = not code
        elif c == "$" and not code:
            math = not math
        elif c in _SWAP and not code and not math:
            return _SWAP[c]
        return c

    return _STEP.sub(step, line)


def mirrored(text: str) -> str:
    """Arrows of lines that hold right-to-left signs point the other way, except in fences,
    code and formulas."""
    if "→" not in text and "←" not in text:
        return text
    out, fenced = [], False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and contains_rtl(line):
            line = _mirrored_line(line)
        out.append(line)
    return "\n".join(out)


def normalised(text: str) -> str:
    return mirrored(folded(text))
