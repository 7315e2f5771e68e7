"""Inline Markdown: code spans, math, links, emphasis and its relatives.

A text is read once from left to right into a chain of nodes. Marks that may open or close
something go on a list of delimiters; brackets go on a list of their own. When a bracket
closes, or the text ends, delimiters are paired from the closers backwards to their nearest
opener. Where the search for an end could be made again and again (code, math, comments,
brackets of notes), all ends are found in one pass, so that the work grows with the text.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left

from .tree import Node

ESCAPABLE = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*)>")
_MAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_TAG = re.compile(r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*|!--(?:>|->|.*?-->|-->)|\?.*?\?|![A-Za-z][^>]*|!\[CDATA\[.*?\]\])>", re.S)
_COMMENT = re.compile(r"<!--(?:-?>|.*?-->)", re.S)
_BARE = re.compile(r"(?:https?://|ftp://|www\.)[^\s<]+")
_BACK = re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]+))?\]\]")
_NOTE = re.compile(r"\[\^([^\]\s]{1,999})\]")
_HOST = re.compile(r"@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._+-]*\Z")
_TITLE = re.compile(r"[ \t\n]+(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\))", re.S)
_LABEL = re.compile(r"\[((?:\\.|[^\[\]\\]){0,999})\]", re.S)
#: Depths and lengths beyond which marks are plain text.
LONGEST_LABEL, DEEPEST_PARENTHESIS, DEEPEST_NOTE = 999, 32, 16
#: Stretches without a sign that may mean something, where no bare link can be, and where
#: one may begin; such a place is at a letter that no letter or digit stands before.
_PLAIN = re.compile(r"(?:[^\\`*_~=+|^$\[\]!<&\n@]++|!(?!\[))++")
_PLAIN_BARE = re.compile(r"(?:[^\\`*_~=+|^$\[\]!<&\n@whf]++|!(?!\[)|h(?!ttps?://[^\s<])|f(?!tp://[^\s<])|w(?!ww\.[^\s<])|(?<=[^\W_])[whf])++")
_TICKS, _FULL, _OPENED, _CLOSED = (re.compile(x) for x in ("`+", r"\S", r"\([ \t\n]*", r"[ \t\n]*\)"))
#: Marks with a length at which they mean something, and what.
PAIRED = {("~", 2): "strike", ("~", 1): "subscript", ("^", 1): "superscript", ("=", 2): "highlight", ("+", 2): "insert", ("|", 2): "spoiler"}


def unescaped(text: str) -> str:
    """Backslash escapes and entities of a destination or title."""
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: "\x00" + m[1], text)
    return re.sub(_ENTITY, lambda m: html.unescape(m[0]), text).replace("\x00", "")


def label_key(label: str) -> str:
    return " ".join(label.split()).casefold()


def _space(c: str) -> bool:
    return not c or c.isspace()


def _mark(c: str) -> bool:
    return bool(c) and unicodedata.category(c)[0] in "PS"


def _east_asian(c: str) -> bool:
    return bool(c) and unicodedata.east_asian_width(c) in "WF"


class _Item:
    """A node in the chain of what was read, with its neighbours."""

    __slots__ = ("after", "before", "marks", "node")

    def __init__(self, node):
        self.node, self.before, self.after, self.marks = node, None, None, False


class _Delimiter:
    __slots__ = ("can_close", "can_open", "char", "item", "number", "size", "start")

    def __init__(self, item, char, size, can_open, can_close, number):
        self.item, self.char, self.size, self.start, self.can_open, self.can_close, self.number = item, char, size, size, can_open, can_close, number


class _Chain:
    """Nodes in order; neighbours are known, so that stretches can be taken out of it."""

    def __init__(self):
        self.head = self.last = _Item(None)

    def add(self, node: Node) -> _Item:
        item = _Item(node)
        item.before, self.last.after = self.last, item
        self.last = item
        return item

    def drop(self, item: _Item) -> None:
        item.before.after = item.after
        if item.after is None:
            self.last = item.before
        else:
            item.after.before = item.before

    def between(self, left: _Item, right: _Item | None) -> list[Node]:
        """Takes out and returns what stands between two items (to the end, if None). What is
        taken out is no longer a ring, so that it goes at once."""
        out, item = [], left.after
        while item is not right:
            out.append(item.node)
            item.before = None
            item = item.after
        left.after = right
        if right is None:
            self.last = left
        else:
            right.before = left
        return out

    def put(self, left: _Item, node: Node) -> None:
        item = _Item(node)
        item.before, item.after = left, left.after
        if left.after is None:
            self.last = item
        else:
            left.after.before = item
        left.after = item

    def nodes(self) -> list[Node]:
        return self.between(self.head, None)


class Inlines:
    def __init__(self, text: str, references: dict, extended: bool, footnotes: set[str], depth: int = 0):
        self.text, self.references, self.extended, self.footnotes, self.depth = text, references, extended, footnotes, depth
        self.bare = extended and ("://" in text or "www." in text)
        self.plain = _PLAIN_BARE if self.bare else _PLAIN
        self.at, self.out, self.delimiters, self.brackets, self.count = 0, _Chain(), [], [], 0
        self.dead = 0  # brackets below this place on their list stand around a link
        self.inline_notes: list[list[Node]] = []
        self.found: dict = {}  # ends of constructs, by kind

    def parse(self) -> list[Node]:
        n, text, plain, add = len(self.text), self.text, self.plain.match, self.out.add
        while self.at < n:
            if not self.bare and (m := plain(text, self.at)):  # prose, to the next sign that may mean something
                add(Node("text", m[0]))
                self.at = m.end()
            elif not self._step():
                self._text(self.text[self.at])
                self.at += 1
        self._pair(0)
        return _joined(self.out.nodes())

    def _text(self, value: str) -> _Item:
        return self.out.add(Node("text", value))

    def _step(self) -> bool:
        text, at = self.text, self.at
        c = text[at]
        if self.bare and c in "whf" and (at == 0 or not text[at - 1].isalnum()) and self._bare():
            return True
        if m := self.plain.match(text, at):
            self._text(m[0])
            self.at = m.end()
            return True
        if c == "\\":
            after = text[at + 1 : at + 2]
            if after == "\n":
                self.out.add(Node("line_break"))
                self.at = at + 2
                self._skip_spaces()
            elif after and after in ESCAPABLE:
                self._text(after)
                self.at = at + 2
            else:
                return False
            return True
        if c == "\n":
            self.out.add(Node("line_break" if self._trimmed() else "soft_break"))
            self.at = at + 1
            self._skip_spaces()
            return True
        if c == "`":
            return self._code()
        if c == "&":
            if m := _ENTITY.match(text, at):
                value = html.unescape(m[0])
                if value != m[0]:
                    self._text(value)
                    self.at = m.end()
                    return True
            return False
        if c == "<":
            return self._angle()
        if c == "$" and self.extended:
            return self._dollars()
        if c == "[" or c == "!" and text[at + 1 : at + 2] == "[":
            return self._open(c == "!")
        if c == "^" and self.extended and text.startswith("^[", at) and self._inline_note():
            return True
        if c == "]":
            return self._close()
        if c == "@" and self.extended:
            return self._mail_back()
        if c in "*_" or self.extended and c in "~^=+|":
            return self._run(c)
        return False

    def _last_text(self) -> _Item | None:
        item = self.out.last
        return item if item.node is not None and item.node.kind == "text" else None

    def _trimmed(self) -> bool:
        """Takes the spaces off the end of a line; whether there were two or more."""
        spaces = 0
        while item := self._last_text():
            left = item.node.literal.rstrip(" ")
            spaces += len(item.node.literal) - len(left)
            item.node.literal = left
            if left or item.marks:
                break
            self.out.drop(item)
        return spaces >= 2

    def _skip_spaces(self) -> None:
        text, at = self.text, self.at
        while at < len(text) and text[at] in " \t":
            at += 1
        self.at = at

    def _next(self, kind, at: int, find) -> int:
        """The first place from `at` on among those that find() lists, or -1."""
        places = self.found.get(kind)
        if places is None:
            places = self.found[kind] = find()
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def _has(self, mark: str, at: int) -> bool:
        """Whether a mark stands anywhere from `at` on."""
        if mark not in self.found:
            self.found[mark] = self.text.rfind(mark)
        return self.found[mark] >= at

    def _code(self) -> bool:
        text, at = self.text, self.at
        if "`" not in self.found:  # places of runs by their length
            runs = self.found["`"] = {}
            for m in re.finditer("`+", text):
                runs.setdefault(len(m[0]), []).append(m.start())
        size = len(_TICKS.match(text, at)[0])
        end = self._next(("`", size), at + size, lambda: self.found["`"].get(size, []))
        if end < 0:
            self._text("`" * size)
            self.at = at + size
            return True
        value = text[at + size : end].replace("\n", " ")
        if len(value) > 2 and value[0] == value[-1] == " " and value.strip(" "):
            value = value[1:-1]
        self.at = end + size
        before = self._last_text()
        if self.extended and before and before.node.literal.endswith("$") and text[self.at : self.at + 1] == "$" and text[at - 1 : at] == "$":
            before.node.literal = before.node.literal[:-1]
            self.at += 1
            self.out.add(Node("math", value, display=False))
        else:
            self.out.add(Node("code", value))
        return True

    def _angle(self) -> bool:
        text, at = self.text, self.at
        for mark, end in (("<!--", ">"), ("<![CDATA[", "]]>"), ("<?", "?>"), ("<", ">")):
            if text.startswith(mark, at):
                if not self._has(end, at) or mark == "<!--" and not self._has("-->", at) and not text.startswith(("<!-->", "<!--->"), at):
                    return False
                break
        if m := _URI.match(text, at):
            self.out.add(Node("link", url=m[1], title="").add(Node("text", m[1])))
        elif m := _MAIL.match(text, at):
            self.out.add(Node("link", url="mailto:" + m[1], title="").add(Node("text", m[1])))
        elif m := _COMMENT.match(text, at) or _TAG.match(text, at):
            self.out.add(Node("html_inline", m[0]))
        else:
            return False
        self.at = m.end()
        return True

    def _dollars(self) -> bool:
        text, at = self.text, self.at
        size = 2 if text.startswith("$$", at) else 1
        if size == 1 and text[at + 1 : at + 2] == "`":  # decided by the code span that follows
            self._text("$")
            self.at += 1
            return True
        start = at + size
        if size == 1 and (_space(text[start : start + 1])):
            return False

        def closers():
            places = [m.start() for m in re.finditer(r"(?=\$\$)" if size == 2 else r"\$", text)]
            return [i for i in places if i and text[i - 1] != "\\" and (size == 2 or not _space(text[i - 1]) and not text[i + 1 : i + 2].isdigit() and text[i + 1 : i + 2] != "$")]

        least = start  # a formula holds more than white space
        if size == 2:
            m = _FULL.search(text, start)
            least = m.start() + 1 if m else len(text)
        end = self._next(("$", size), least, closers)
        if end >= 0 and text[start:end].strip():
            self.out.add(Node("math", text[start:end], display=size == 2))
            self.at = end + size
            return True
        self._text("$" * size)
        self.at = start
        return True

    def _bare(self) -> bool:
        m = _BARE.match(self.text, self.at)
        if not m:
            return False
        url, opened, closed = m[0], m[0].count("("), m[0].count(")")
        while True:  # closing marks of the sentence stay outside
            cut = url.rstrip("?!.,:*_~'\"")
            if cut.endswith(")") and closed > opened:
                cut, closed = cut[:-1], closed - 1
            if cut.endswith(";") and (e := re.search(r"&[A-Za-z0-9]+;$", cut[-40:])):
                cut = cut[: len(cut) - len(e[0])]
            if cut == url:
                break
            url = cut
        host = re.match(r"(?:https?://|ftp://)?([^/?#:]*)", url)[1]
        if not host or url.startswith("www.") and "." not in host[4:]:
            return False
        self.out.add(Node("link", url=url if "://" in url else "http://" + url, title="").add(Node("text", url)))
        self.at += len(url)
        return True

    def _mail_back(self) -> bool:
        """An address around this @, of which the local part was already read as text."""
        right = _HOST.match(self.text, self.at)
        if not right or right[0][-1] in "-_":
            return False
        item, local = self._last_text(), ""
        while item is not None and item.node is not None and item.node.kind == "text":
            end = _LOCAL.search(item.node.literal)[0]
            local = end + local
            if len(end) < len(item.node.literal):
                break
            item = item.before
        if not local:
            return False
        need = len(local)
        while need:
            last = self.out.last
            if last.marks:
                self.delimiters = [d for d in self.delimiters if d.item is not last]
            if len(last.node.literal) <= need:
                need -= len(last.node.literal)
                self.out.drop(last)
            else:
                last.node.literal = last.node.literal[:-need]
                need = 0
        address = local + right[0]
        self.out.add(Node("link", url="mailto:" + address, title="").add(Node("text", address)))
        self.at = right.end()
        return True

    def _open(self, image: bool) -> bool:
        text, at = self.text, self.at
        if self.extended and not image and text.startswith("[[", at) and (m := _BACK.match(text, at)):
            self.out.add(Node("wikilink", url=m[1].strip()).add(Node("text", (m[2] or m[1]).strip())))
            self.at = m.end()
            return True
        if self.extended and not image and (m := _NOTE.match(text, at)) and label_key(m[1]) in self.footnotes:
            self.out.add(Node("footnote_ref", name=m[1]))
            self.at = m.end()
            return True
        size = 2 if image else 1
        item = self._text(text[at : at + size])
        self.at = at + size
        self.brackets.append((item, len(self.delimiters), image, self.at))
        return True

    def _inline_note(self) -> bool:
        if "[" not in self.found:  # each bracket's partner, in one pass
            pairs, open_ = {}, []
            self.found["["] = pairs
            for m in re.finditer(r"\\.|[\[\]]", self.text, re.S):
                if m[0] == "[":
                    open_.append(m.start())
                elif m[0] == "]" and open_:
                    pairs[open_.pop()] = m.start()
        end = self.found["["].get(self.at + 1)
        if end is None or self.depth >= DEEPEST_NOTE:
            return False
        inner = Inlines(self.text[self.at + 2 : end], self.references, self.extended, self.footnotes, self.depth + 1)
        self.inline_notes.append(inner.parse())
        self.inline_notes.extend(inner.inline_notes)
        self.out.add(Node("footnote_ref", name="", inline=len(self.inline_notes) - 1 - len(inner.inline_notes)))
        self.at = end + 1
        return True

    def _close(self) -> bool:
        if not self.brackets:
            return False
        item, bottom, image, start = self.brackets.pop()
        alive = image or len(self.brackets) >= self.dead
        self.dead = min(self.dead, len(self.brackets))
        if not alive:
            return False
        target = self._inline_target(self.at + 1) or self._reference(start)
        if not target:
            return False
        url, title, self.at = target
        self._pair(bottom)
        link = Node("image" if image else "link", url=url, title=title)
        link.children = _joined(self.out.between(item, None))
        self.out.drop(item)
        self.out.add(link)
        if not image:  # no links in links
            self.dead = len(self.brackets)
        return True

    def _inline_target(self, at: int):
        text = self.text
        if text[at : at + 1] != "(":
            return None
        m = _OPENED.match(text, at)
        found = destination(text, m.end())
        if found is None:
            return None
        url, at = found
        title = ""
        if m := _TITLE.match(text, at):
            title, at = unescaped(m[1][1:-1]), m.end()
        if m := _CLOSED.match(text, at):
            return unescaped(url), title, m.end()
        return None

    def _reference(self, start: int):
        text, at = self.text, self.at
        own = text[start:at] if at - start <= LONGEST_LABEL else ""
        if m := _LABEL.match(text, at + 1):
            label, end = m[1].strip() or own, m.end()
            found = self.references.get(label_key(label))
            return (*found, end) if found else None
        found = self.references.get(label_key(own))
        return (*found, at + 1) if found else None

    def _run(self, c: str) -> bool:
        text, at = self.text, self.at
        end = at
        while end < len(text) and text[end] == c:
            end += 1
        size, before, after = end - at, text[at - 1 : at] if at else "", text[end : end + 1]
        left = not _space(after) and (not _mark(after) or _space(before) or _mark(before) or self.extended and _east_asian(before))
        right = not _space(before) and (not _mark(before) or _space(after) or _mark(after) or self.extended and _east_asian(after))
        if c == "_":
            opens, closes = left and (not right or _mark(before)), right and (not left or _mark(after))
        else:
            opens, closes = left, right
        if c not in "*_" and (c, size) not in PAIRED:
            opens = closes = False
        item = self._text(text[at:end])
        if opens or closes:
            item.marks, self.count = True, self.count + 1
            self.delimiters.append(_Delimiter(item, c, size, opens, closes, self.count))
        self.at = end
        return True

    def _pair(self, bottom: int) -> None:
        """Pairs the delimiters above `bottom` and drops them. Openers that still wait are
        on a stack; a search that found none is not made again below its place."""
        waiting: list[_Delimiter] = []
        floor: dict = {}
        for closer in self.delimiters[bottom:]:
            while closer.can_close and closer.size:
                key = (closer.char, closer.can_open, closer.start % 3, closer.size if closer.char not in "*_" else 0)
                j, least = len(waiting) - 1, floor.get(key, 0)
                while j >= 0 and waiting[j].number >= least and not _fits(waiting[j], closer):
                    j -= 1
                if j < 0 or waiting[j].number < least:
                    floor[key] = closer.number
                    break
                opener = waiting[j]
                used = (2 if opener.size >= 2 and closer.size >= 2 else 1) if closer.char in "*_" else closer.size
                kind = PAIRED.get((closer.char, used)) if closer.char not in "*_" else "strong" if used == 2 else "emph"
                if closer.char == "_" and used == 2 and self.extended:
                    kind = "underline"
                made = Node(kind)
                made.children = _joined(self.out.between(opener.item, closer.item))
                self.out.put(opener.item, made)
                del waiting[j + 1 :]
                for d in (opener, closer):
                    d.size -= used
                    d.item.node.literal = d.item.node.literal[: len(d.item.node.literal) - used]
                    if not d.size:
                        self.out.drop(d.item)
                if not opener.size:
                    waiting.pop()
            if closer.can_open and closer.size:
                waiting.append(closer)
        del self.delimiters[bottom:]


def _fits(opener: _Delimiter, closer: _Delimiter) -> bool:
    if opener.char != closer.char:
        return False
    if closer.char not in "*_":
        return opener.size == closer.size
    odd = (opener.can_close or closer.can_open) and (opener.start + closer.start) % 3 == 0 and (opener.start % 3 or closer.start % 3)
    return not odd


def destination(text: str, at: int):
    """(link destination, its end) at a place, or None."""
    if text[at : at + 1] == "<":
        m = re.compile(r"<((?:\\.|[^<>\n\\])*)>").match(text, at)
        return (m[1], m.end()) if m else None
    depth, i = 0, at
    while i < len(text) and text[i] > " " and text[i] != "\x7f":
        if text[i] == "\\" and text[i + 1 : i + 2] in ESCAPABLE and i + 1 < len(text):
            i += 1
        elif text[i] == "(":
            depth += 1
            if depth > DEEPEST_PARENTHESIS:
                return None
        elif text[i] == ")":
            if not depth:
                break
            depth -= 1
        i += 1
    return None if depth else (text[at:i], i)


def _joined(nodes: list[Node]) -> list[Node]:
    """Neighbouring texts become one; empty ones go."""
    out: list[Node] = []
    texts: list[str] = []
    for x in nodes:
        if x.kind == "text":
            texts.append(x.literal)
            continue
        if any(texts):
            out.append(Node("text", "".join(texts)))
        texts = []
        out.append(x)
    if any(texts):
        out.append(Node("text", "".join(texts)))
    return out
