"""LaTeX mathematics to a small tree, and the tree to OMML or MathML.

Both outputs walk the same tree: ("run", text), ("row", nodes), ("frac", a, b),
("root", a), ("script", base, sub, sup), ("matrix", environment, rows). Rows without
anything in them are left out. Formulas may nest to any depth: the reader's steps are
generators on an explicit stack, and so are the parts of what is written."""

from __future__ import annotations

import re

from . import values
from .tree import Kept, written

_TOKEN = re.compile(r"\s+|\\\\|\\([A-Za-z]+)|\\(.)|(.)|(\\)$", re.S)
_INVALID = re.compile("[^\t\n\r -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def xml_text(text: str) -> str:
    """Escaped for XML, without the signs that XML does not allow."""
    if text.isalnum():
        return text
    text = (text if text.isprintable() else _INVALID.sub("", text)).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;").replace("'", "&apos;")


def html_text(text: str) -> str:
    return xml_text(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text)).replace("&apos;", "&#39;")


def tokens(source: str) -> list[tuple[str, str]]:
    """(type, value): row, command, char, open, close, sup, sub or cell."""
    special = {"{": "open", "}": "close", "^": "sup", "_": "sub", "&": "cell"}
    out = []
    for m in _TOKEN.finditer(source):
        if m[0] == "\\\\":
            out.append(("row", ""))
        elif m[1]:
            out.append(("command", m[1]))
        elif m[2] is not None:
            out.append(("char", m[2]))
        elif m[3] is not None and not m[3].isspace():
            out.append((special.get(m[3], "char"), m[3] if m[3] not in special else ""))
        elif m[4]:
            out.append(("char", "\\"))
    return out


NOTHING = ("row", [])


class _Reader:
    """Each step yields the steps it waits for and returns a node."""

    def __init__(self, source: str):
        self.tokens, self.at = tokens(source), 0

    def kind(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def row(self):
        nodes, tokens = [], self.tokens
        while self.at < len(tokens) and tokens[self.at][0] not in ("close", "cell", "row"):
            if tokens[self.at][0] == "char" and (self.at + 1 == len(tokens) or tokens[self.at + 1][0] not in ("sub", "sup")):  # stands alone
                nodes.append(("run", tokens[self.at][1]))
                self.at += 1
                continue
            node = yield self.scripted()
            if node != NOTHING:
                nodes.append(node)
        return ("row", nodes)

    def braced(self):
        self.at += 1
        inner = yield self.row()
        if self.kind() == "close":
            self.at += 1
        return inner

    def group(self):
        return self.braced() if self.kind() == "open" else self.scripted()

    def scripted(self):
        base, scripts = (yield self.atom()), {}
        while (side := self.kind()) in ("sub", "sup"):
            self.at += 1
            scripts[side] = yield self.group()
        return ("script", base, scripts.get("sub", NOTHING), scripts.get("sup", NOTHING)) if scripts else base

    def atom(self):
        kind = self.kind()
        if kind is None:
            return NOTHING
        if kind == "open":
            return (yield self.braced())
        value = self.tokens[self.at][1]
        self.at += 1
        if kind == "char":
            return ("run", value)
        if kind != "command" or value in values.DROPPED:
            return NOTHING
        if value in values.FRACTIONS:
            above = yield self.group()
            return ("frac", above, (yield self.group()))
        if value == "sqrt":
            return ("root", (yield self.group()))
        if value in values.GROUPS:
            return (yield self.group())
        return ("run", values.SYMBOLS.get(value, "\\" + value))


def _stepped(first):
    """Runs a step and all that it waits for, without recursion."""
    stack, value = [first], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def read(source: str):
    """The tree of a formula. A matrix counts only if it is the whole formula."""
    whole = source.strip()
    for name in values.MATRICES:
        head, foot = f"\\begin{{{name}}}", f"\\end{{{name}}}"
        if whole.startswith(head) and whole.endswith(foot) and len(whole) >= len(head) + len(foot):
            body = whole[len(head) : len(whole) - len(foot)]
            return ("matrix", name, [[_stepped(_Reader(c.strip()).row()) for c in line.split("&")] for line in body.split("\\\\")])
    return _stepped(_Reader(source).row())


def _empty(node) -> bool:
    return node[0] == "row" and not node[1]


def _omml(node) -> list:
    """What a node is written as in OMML."""
    kind = node[0]
    if kind == "row":
        return node[1]
    if kind == "run":
        return [f"<m:r><m:t>{xml_text(node[1])}</m:t></m:r>"]
    if kind == "frac":
        return ["<m:f><m:num>", node[1], "</m:num><m:den>", node[2], "</m:den></m:f>"]
    if kind == "root":
        return ['<m:rad><m:radPr><m:degHide m:val="1"/></m:radPr><m:deg/><m:e>', node[1], "</m:e></m:rad>"]
    if kind == "script":
        _, base, below, above = node
        name = "s" + "".join(n for n, x in (("Sub", below), ("Sup", above)) if not _empty(x))
        parts = [("e", base), *[(t, x) for t, x in (("sub", below), ("sup", above)) if not _empty(x)]]
        inner = [y for t, x in parts for y in (f"<m:{t}>", x, f"</m:{t}>")]
        return [f"<m:{name}>", *inner, f"</m:{name}>"] if name != "s" else [base]
    _, name, rows = node
    table = ["<m:m>", *[y for row in rows for y in ("<m:mr>", *[z for c in row for z in ("<m:e>", c, "</m:e>")], "</m:mr>")], "</m:m>"]
    begin, end = values.MATRICES[name]
    return [f'<m:d><m:dPr><m:begChr m:val="{begin}"/><m:endChr m:val="{end}"/></m:dPr><m:e>', *table, "</m:e></m:d>"] if begin else table


def _token(text: str) -> str:
    return _TOKENS.get(text) or (_TOKENS.keep(text, _tagged(text)) if len(text) <= SHORT else _tagged(text))


def _tagged(text: str) -> str:
    if text and all(c.isnumeric() or c == "." for c in text):
        tag = "mn"
    else:
        tag = "mi" if text and all(c.isalpha() for c in text) else "mo"
    return f"<{tag}>{html_text(text)}</{tag}>"


def _mathml(node) -> list:
    """What a node is written as in MathML."""
    kind = node[0]
    row = lambda n: ("<mrow>", n, "</mrow>")
    if kind == "row":
        return node[1]
    if kind == "run":
        return [_token(node[1])]
    if kind == "frac":
        return ["<mfrac>", *row(node[1]), *row(node[2]), "</mfrac>"]
    if kind == "root":
        return ["<msqrt>", *row(node[1]), "</msqrt>"]
    if kind == "script":
        _, base, below, above = node
        name = "m" + ("" if _empty(below) else "sub") + ("" if _empty(above) else "sup")
        return [base] if name == "m" else [f"<{name}>", *row(base), *([] if _empty(below) else row(below)), *([] if _empty(above) else row(above)), f"</{name}>"]
    _, name, rows = node
    table = ["<mtable>", *[y for r in rows for y in ("<mtr>", *[z for c in r for z in ("<mtd>", *row(c), "</mtd>")], "</mtr>")], "</mtable>"]
    begin, end = values.MATRICES[name]
    return [f"<mrow><mo>{begin}</mo>", *table, f"<mo>{end}</mo></mrow>"] if begin else table


#: Formulas and their tokens of so many signs, as they were written.
SHORT, _KNOWN, _TOKENS = 80, Kept(), Kept()


def _formula(source: str, parts) -> str:
    if len(source) > SHORT:
        return written(read(source), parts)
    key = source, parts is _omml
    found = _KNOWN.get(key)
    return _KNOWN.keep(key, written(read(source), parts)) if found is None else found


def to_omml(source: str, display: bool = False) -> str:
    formula = f"<m:oMath>{_formula(source, _omml)}</m:oMath>"
    return f'<m:oMathPara><m:oMathParaPr><m:jc m:val="centerGroup"/></m:oMathParaPr>{formula}</m:oMathPara>' if display else formula


def to_mathml(source: str, display: bool = False) -> str:
    kind = "display" if display else "inline"
    return (
        f'<math xmlns="http://www.w3.org/1998/Math/MathML" class="paperloom-math-{kind}" display="{"block" if display else "inline"}" dir="ltr" style="{values.MATH_STYLE[display]}">'
        f"<mrow>{_formula(source, _mathml)}</mrow></math>"
    )
