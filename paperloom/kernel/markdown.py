"""Markdown blocks: CommonMark 0.31.2, tables and task lists of GFM, and, unless the dialect
is commonmark, footnotes, alerts, description lists, subtext, directives and more.

Lines are read one by one against a path of open blocks. A line first goes down the path
as far as the containers accept it, then may start new blocks, and its rest becomes text
of the deepest one. Inlines are parsed at the end, when all link references are known.
Containers nest DEEPEST deep at most: markers beyond that are text. Trees are walked with
explicit stacks, never by recursion.
"""

from __future__ import annotations

import re

from .inlines import Inlines, destination, label_key, unescaped
from .tree import Kept, Node

_RULE = re.compile(r"(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]|$)")
_ITEM = re.compile(r"([-+*])(?=[ \t]|$)|([0-9]{1,9})([.)])(?=[ \t]|$)")
_NOTE = re.compile(r"\[\^([^\]\s]+)\]:[ \t]*")
_ALERT = re.compile(r"\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\](?:[ \t]+(.*))?[ \t]*$", re.I)
_TASK = re.compile(r"\[([ xX])\](?:[ \t]+|$)")
_UNDERLINE, _SUBTEXT, _DIRECTIVE = (re.compile(x) for x in (r"(=+|-+)[ \t]*", r"-#[ \t]+(.*)$", r":{3,}"))
_CELL_RULE = re.compile(r"[ \t]*:?-+:?[ \t]*$")
#: The tag names that start an HTML block of the sixth kind.
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[ \t>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(_BLOCK_TAGS.split())})(?:[ \t]|/?>|$)", re.I), None),
    (re.compile(r"(?:<[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)[ \t]*$"), None),
]
#: Path of open blocks (a list and its item count as two), and cells that may be filled up in one table.
DEEPEST, FILLED = 200, 500_000
CONTAINERS = {"document", "quote", "multiline_quote", "alert", "list", "item", "footnote", "description_details", "directive"}
TEXTS = {"paragraph", "heading", "subtext", "cell", "description_term"}


class _Block:
    def __init__(self, kind: str, **attrs):
        self.kind, self.attrs, self.children, self.lines, self.open = kind, attrs, [], [], True
        self.blank_after = False


_WHITE = (" ", "\t")


def _ends(mark: str, rest: str) -> bool:
    """Whether a line is a mark that closes what this one has opened: of the same sign, as long."""
    return len(rest) >= len(mark) and not rest.strip(mark[0])


class _Line:
    """What is left of a line, and the column it starts at."""

    def __init__(self, text: str):
        self.rest, self.column = text, 0

    def indent(self) -> int:
        if self.rest[:1] not in _WHITE:
            return 0
        stripped = self.rest.lstrip(" ")
        width = len(self.rest) - len(stripped)
        if not stripped.startswith("\t"):
            return width
        for c in stripped:
            if c == " ":
                width += 1
            elif c == "\t":
                width += 4 - (self.column + width) % 4
            else:
                break
        return width

    @property
    def blank(self) -> bool:
        return not self.rest.strip(" \t")

    def skip(self, width: int) -> None:
        """Takes away so many columns of white space; a tab may be split."""
        while width > 0 and self.rest[:1] in (" ", "\t"):
            step = 1 if self.rest[0] == " " else 4 - self.column % 4
            if step <= width:
                self.rest, self.column, width = self.rest[1:], self.column + step, width - step
            else:
                self.rest, self.column, width = " " * (step - width) + self.rest[1:], self.column + width, 0

    def take(self, n: int) -> None:
        self.rest, self.column = self.rest[n:], self.column + n


class Blocks:
    def __init__(self, text: str, extended: bool):
        self.extended, self.references, self.root = extended, {}, _Block("document")
        self.path = [self.root]
        text = (text[:-1] if text.endswith("\n") else text).replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�")
        for line in text.split("\n"):
            self._line(line)
        self._close(0)

    def _close(self, depth: int) -> None:
        for block in self.path[depth + 1 :]:
            block.open = False
        del self.path[depth + 1 :]

    def _line(self, raw: str) -> None:
        if (not raw or raw[0].isalpha()) and self._prose(raw):
            return
        line, depth = _Line(raw), 0
        self.ended = False  # whether the line closes a block that it names
        for block in self.path[1:]:
            if not self._continues(block, line):
                break
            if self.ended:
                return
            depth += 1
        matched = self.path[depth]
        fresh = depth < len(self.path) - 1
        lazy = self.path[-1] if fresh and self.path[-1].kind == "paragraph" else None
        if matched.kind in ("code_block", "html_block") and not fresh:
            self._add(matched, line)
            return
        parent_depth = depth if matched.kind in CONTAINERS else depth - 1
        paragraph = matched if matched.kind == "paragraph" else None
        while True:
            started = self._start(line, parent_depth, paragraph, lazy)
            if not started:
                break
            lazy = paragraph = None
            fresh = False
            if started == "leaf":
                return
            parent_depth = len(self.path) - 1
        deepest = self.path[-1]
        if line.blank:
            self._blank(depth if fresh else len(self.path) - 1, fresh)
        elif lazy is not None and fresh:
            lazy.lines.append(line.rest.lstrip(" \t"))
        elif deepest.kind == "paragraph" and not fresh:
            deepest.lines.append(line.rest.lstrip(" \t"))
        elif deepest.kind == "table" and not fresh and self._room(deepest, line.rest):
            deepest.lines.append(line.rest.strip())
        else:
            if fresh:
                self._close(parent_depth)
            block = self._push(_Block("paragraph"))
            block.lines.append(line.rest.lstrip(" \t"))

    def _prose(self, raw: str) -> bool:
        """Most lines: empty ones and those that begin with a letter, outside of containers, after
        nothing or a paragraph. They begin no block, so there is nothing to ask. False for others."""
        path, last = self.path, self.path[-1]
        if len(path) > 2 or len(path) == 2 and last.kind != "paragraph":
            return False
        if not raw:
            self._blank(0, True)
        elif len(path) == 2:
            last.lines.append(raw)
        else:
            self._push(_Block("paragraph")).lines.append(raw)
        return True

    @staticmethod
    def _room(table: _Block, rest: str) -> bool:
        """Whether a table may take a row: cells that rows lack are filled up, to a bound."""
        table.attrs["filled"] += max(0, len(table.attrs["sides"]) - 1 - rest.count("|"))
        return table.attrs["filled"] <= FILLED

    def _blank(self, depth: int, fresh: bool) -> None:
        if fresh:
            self._close(depth)
        if self.path[-1].kind in ("paragraph", "table"):
            self._close(len(self.path) - 2)
        for block in self.path:
            block.blank_after = True
            if block.children:
                block.children[-1].blank_after = True

    def _push(self, block: _Block) -> _Block:
        while self.path[-1].kind not in CONTAINERS or self.path[-1].kind == "list" and block.kind != "item":
            self._close(len(self.path) - 2)
        self.path[-1].children.append(block)
        self.path.append(block)
        return block

    def _continues(self, block: _Block, line: _Line) -> bool:
        kind = block.kind
        if kind in ("quote", "alert"):
            if line.indent() < 4 and line.rest.lstrip(" \t").startswith(">") and not line.blank:
                line.skip(line.indent())
                line.take(1)
                line.skip(1)
                return True
            return False
        if kind in ("multiline_quote", "directive"):
            mark = block.attrs["mark"]
            if line.indent() < 4 and _ends(mark, line.rest.strip()):
                self._close(self.path.index(block) - 1)
                self.ended = True
            return True
        if kind == "list":
            return True
        if kind in ("item", "footnote", "description_details"):
            need = block.attrs["indent"]
            if line.blank:
                return bool(block.children) or not block.blank_after
            if line.indent() >= need:
                line.skip(need)
                return True
            return False
        if kind == "code_block":
            if block.attrs.get("fence"):
                mark = block.attrs["fence"]
                if line.indent() < 4 and _ends(mark, line.rest.strip(" \t")):
                    self._close(self.path.index(block) - 1)
                    self.ended = True
                    return True
                line.skip(min(line.indent(), block.attrs["offset"]))
                return True
            if line.blank:
                line.skip(4)
                return True
            if line.indent() >= 4:
                line.skip(4)
                return True
            return False
        if kind == "html_block":
            return not (line.blank and block.attrs["end"] is None)
        if kind in ("paragraph", "table"):
            return not line.blank
        return False

    def _add(self, block: _Block, line: _Line) -> None:
        block.lines.append(line.rest)
        if block.kind == "html_block" and block.attrs["end"] is not None and block.attrs["end"].search(line.rest):
            self._close(self.path.index(block) - 1)

    def _start(self, line: _Line, depth: int, paragraph, lazy):
        """Starts a block at this place: "leaf" if the line is used up, True for a container."""
        if line.rest[:1].isalpha() or line.blank:  # no block starts with a letter
            return None
        indent, rest = line.indent(), line.rest.lstrip(" \t")
        continuing = paragraph is not None or lazy is not None
        if indent >= 4:
            if continuing:
                return None
            self._close(depth)
            line.skip(4)
            block = self._push(_Block("code_block", fence="", info="", offset=0))
            block.lines.append(line.rest)
            return "leaf"
        if paragraph is not None and self._underline(paragraph, rest):
            return "leaf"
        if paragraph is not None and self.extended and self._table(paragraph, rest):
            return "leaf"
        if self.extended and depth < DEEPEST and rest.startswith(">>>") and not rest.rstrip(" \t").strip(">"):
            self._close(depth)
            self._push(_Block("multiline_quote", mark=rest.strip()))
            return "leaf"
        if rest.startswith(">") and depth < DEEPEST:
            self._close(depth)
            line.skip(indent)
            line.take(1)
            line.skip(1)
            alert = _ALERT.match(line.rest.strip()) if self.extended else None
            if alert:
                self._push(_Block("alert", type=alert[1].lower(), title=(alert[2] or "").strip() or None))
                return "leaf"
            self._push(_Block("quote"))
            return True
        first = rest[0]
        if first == "#" and (m := _HEADING.match(rest)):
            self._close(depth)
            block = self._push(_Block("heading", level=len(m[1])))
            title = rest[m.end(1) :].strip(" \t")
            bare = title.rstrip("#")
            block.lines.append(title.strip() if bare and bare[-1] not in " \t" else bare.strip())
            self._close(len(self.path) - 2)
            return "leaf"
        if first in "`~" and (m := _FENCE.match(rest)):
            self._close(depth)
            self._push(_Block("code_block", fence=m[1] or m[3], info=unescaped((m[2] or m[4] or "").strip()), offset=indent))
            return "leaf"
        for i, (begin, end) in enumerate(_HTML if first == "<" else ()):
            if begin.match(rest) and not (i == 6 and continuing):
                self._close(depth)
                block = self._push(_Block("html_block", end=end))
                self._add(block, line)
                return "leaf"
        if self.extended and first == "-" and (m := _SUBTEXT.match(rest)):
            self._close(depth)
            self._push(_Block("subtext")).lines.append(m[1].strip())
            self._close(len(self.path) - 2)
            return "leaf"
        if first in "*-_" and _RULE.match(rest):
            self._close(depth)
            self._push(_Block("rule"))
            self._close(len(self.path) - 2)
            return "leaf"
        if self.extended and depth < DEEPEST and first == ":" and (m := _DIRECTIVE.match(rest)):
            self._close(depth)
            self._push(_Block("directive", mark=m[0], info=rest[m.end() :].strip(" \t")))
            return "leaf"
        if self.extended and depth < DEEPEST and first == "[" and (m := _NOTE.match(rest)):
            self._close(depth)
            line.skip(indent)
            line.take(m.end())
            self._push(_Block("footnote", name=m[1], indent=4))
            return True
        if self.extended and depth < DEEPEST and rest.startswith((": ", ":\t")) and self._details(depth, line, indent):
            return True
        return self._item(line, depth, indent, rest, continuing)

    def _underline(self, paragraph: _Block, rest: str) -> bool:
        if not _UNDERLINE.fullmatch(rest):
            return False
        self._take_references(paragraph)
        if not paragraph.lines:
            return False
        paragraph.kind, paragraph.attrs = "heading", {"level": 1 if rest[0] == "=" else 2}
        self._close(self.path.index(paragraph) - 1)
        return True

    def _table(self, paragraph: _Block, rest: str) -> bool:
        if "-" not in rest or ("|" not in rest and ":" not in rest):
            return False
        rule = cells_of(rest)
        if not rule or not all(_CELL_RULE.match(c) and c.strip() for c in rule):
            return False
        head = cells_of(paragraph.lines[-1])
        if len(head) != len(rule):
            return False
        sides = [{(1, 1): "center", (1, 0): "left", (0, 1): "right"}.get((c.strip()[0] == ":", c.strip()[-1] == ":")) for c in rule]
        table = _Block("table", sides=sides, filled=0)
        table.lines.append(paragraph.lines.pop())
        depth = self.path.index(paragraph)
        self._close(depth - 1)
        if not paragraph.lines:
            self.path[-1].children.pop()
        self._push(table)
        return True

    def _details(self, depth: int, line: _Line, indent: int) -> bool:
        """`: text` below a paragraph makes its last line a term."""
        siblings = self.path[depth].children
        last = siblings[-1] if siblings else None
        if last is None or last.kind not in ("paragraph", "description_list"):
            return False
        self._close(depth)
        if last.kind == "paragraph":
            siblings.pop()
            group = siblings[-1] if siblings and siblings[-1].kind == "description_list" else None
            if group is None:
                group = _Block("description_list")
                siblings.append(group)
            item = _Block("description_item")
            term = _Block("description_term")
            term.lines = last.lines
            item.children.append(term)
            group.children.append(item)
        else:
            item = last.children[-1]
        details = _Block("description_details", indent=indent + 2)
        item.children.append(details)
        self.path.append(details)
        line.skip(indent)
        line.take(1)
        line.skip(1)
        return True

    def _item(self, line: _Line, depth: int, indent: int, rest: str, continuing: bool):
        m = _ITEM.match(rest) if depth < DEEPEST else None
        if not m:
            return None
        after = rest[m.end() :]
        empty = not after.strip(" \t")
        if continuing and (empty or m[2] and m[2] != "1") and self.path[depth].kind != "list" and not (depth and self.path[depth].kind == "item"):
            return None
        parent = self.path[depth]
        ordered, mark = m[2] is not None, m[1] or m[3]
        if parent.kind == "list" and (parent.attrs["ordered"], parent.attrs["mark"]) == (ordered, mark):
            self._close(depth)
        else:
            if continuing and (empty or m[2] and m[2] != "1"):
                return None
            self._close(depth - 1 if parent.kind == "list" else depth)
            self._push(_Block("list", ordered=ordered, mark=mark, start=int(m[2]) if ordered else None))
        line.skip(indent)
        line.take(m.end())
        gap = line.indent()
        wide = gap if 1 <= gap <= 4 and not empty else 1
        line.skip(wide)
        item = self._push(_Block("item", indent=indent + m.end() + wide))
        if self.extended and (t := _TASK.match(line.rest)):
            item.attrs["checked"] = t[1] != " "
            line.take(t.end())
        if empty:
            item.blank_after = False
            return "leaf"
        return True

    def _take_references(self, block: _Block) -> None:
        """Link reference definitions at the start of a paragraph."""
        if not block.lines or not block.lines[0].startswith("["):
            return
        text, start = "\n".join(block.lines), 0
        while text.startswith("[", start):
            m = _DEFINITION.match(text, start)
            if not m or not m[1].strip():
                break
            found = destination(text, m.end())
            if not found or not found[0] and not text.startswith("<", m.end()):
                break
            url, at = found
            title, end = "", None
            t = _DEFINITION_TITLE.match(text, at)
            if t and "\n\n" not in t[1]:
                title, end = unescaped(t[1][1:-1]), t.end()
            elif e := _DEFINITION_END.match(text, at):
                end = e.end()
            if end is None:
                break
            self.references.setdefault(label_key(m[1]), (unescaped(url), title))
            start = end
        if start:
            block.lines = text[start:].split("\n") if start < len(text) else []


_DEFINITION = re.compile(r"\[((?:\\.|[^\[\]\\]){1,999})\]:[ \t]*\n?[ \t]*", re.S)
_DEFINITION_TITLE = re.compile(r"(?:[ \t]+|[ \t]*\n[ \t]*)(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\))[ \t]*(?:\n|$)", re.S)
_DEFINITION_END = re.compile(r"[ \t]*(?:\n|$)")


def cells_of(line: str) -> list[str]:
    """Cells of a table row; escaped pipes belong to the text."""
    body = line.strip()
    body = body[1:] if body.startswith("|") else body
    out, cell = [], []
    for m in _CELL.finditer(body):
        if m[0] == "|":
            out.append("".join(cell))
            cell = []
        else:
            cell.append("|" if m[0] == "\\|" else m[0])
    last = "".join(cell)
    if last.strip() or not body.endswith("|"):
        out.append(last)
    return [c.strip() for c in out]


_CELL = re.compile(r"\\\||\||[^|\\]+|\\")


#: Inlines of texts of so many signs that stand for themselves.
SHORT, _KNOWN = 80, Kept()


class _Builder:
    """Blocks to nodes, with their inlines."""

    def __init__(self, blocks: Blocks):
        self.blocks, self.extended = blocks, blocks.extended
        self.notes: list[Node] = []
        self.names = set()
        self._collect(blocks.root)

    def _collect(self, root: _Block) -> None:
        stack = [root]
        while stack:
            block = stack.pop()
            if block.kind == "paragraph":
                self.blocks._take_references(block)
            if block.kind == "footnote":
                self.names.add(label_key(block.attrs["name"]))
            stack.extend(reversed(block.children))

    def inlines(self, text: str) -> list[Node]:
        """Nodes of a text. Short ones (cells, items, titles) come again and again; what they
        are is kept where it depends on nothing else."""
        alone = len(text) <= SHORT and not self.blocks.references and not self.names
        if alone and (found := _KNOWN.get((text, self.extended))) is not None:
            return found
        parser = Inlines(text, self.blocks.references, self.extended, self.names)
        found = parser.parse()
        for note in parser.inline_notes:
            name = f"note-{len(self.notes) + 1}"
            definition = Node("footnote", name=name).add(Node("paragraph").add(*note))
            self.notes.append(definition)
        self._name(found, len(self.notes) - len(parser.inline_notes))
        return _KNOWN.keep((text, self.extended), found) if alone and not parser.inline_notes else found

    @staticmethod
    def _name(nodes: list[Node], base: int) -> None:
        stack = nodes[:]
        while stack:
            node = stack.pop()
            if node.kind == "footnote_ref" and "inline" in node.attrs:
                node.attrs["name"] = f"note-{base + node.attrs.pop('inline') + 1}"
            stack.extend(node.children)

    def build(self, root: _Block) -> Node:
        """The tree of a block, in document order."""
        top = Node("top")
        stack = [(root, top)]
        while stack:
            block, parent = stack.pop()
            node = self.node(block)
            if node is None:
                continue
            parent.children.append(node)
            if block.kind not in TEXTS and block.kind != "table":
                stack.extend((child, node) for child in reversed(block.children))
        return top.children[0]

    def node(self, block: _Block) -> Node | None:
        """One block with its inlines, without its children."""
        kind, attrs = block.kind, block.attrs
        if kind == "paragraph":
            text = "\n".join(block.lines).rstrip()
            return Node("paragraph").add(*self.inlines(text)) if text else None
        if kind in ("heading", "subtext", "description_term"):
            return Node(kind, **attrs).add(*self.inlines("\n".join(block.lines).strip()))
        if kind == "code_block":
            lines = block.lines
            if not attrs["fence"]:
                while lines and not lines[-1].strip(" \t"):
                    lines.pop()
            return Node("code_block", "".join(x + "\n" for x in lines), info=attrs["info"], fenced=bool(attrs["fence"]))
        if kind == "html_block":
            return Node("html_block", "".join(x + "\n" for x in block.lines))
        if kind == "table":
            return self.table(block)
        if kind == "list":
            attrs = attrs | {"tight": self.tight(block)}
        if kind == "item" and "checked" in attrs:
            kind = "task_item"
        return Node(kind, **{k: v for k, v in attrs.items() if k not in ("indent", "mark")})

    def tight(self, block: _Block) -> bool:
        for i, item in enumerate(block.children):
            if item.blank_after and i + 1 < len(block.children):
                return False
            if any(x.blank_after for x in item.children[:-1]):
                return False
        return True

    def table(self, block: _Block) -> Node:
        sides, node = block.attrs["sides"], Node("table")
        for i, line in enumerate(block.lines):
            row = Node("table_row", header=i == 0)
            values = cells_of(line)[: len(sides)]
            for value, side in zip(values + [""] * (len(sides) - len(values)), sides, strict=True):
                cell = Node("table_cell", side=side)
                if self.extended and (t := _TASK.fullmatch(value)):
                    cell.add(Node("task_mark", checked=t[1] != " "))
                else:
                    cell.add(*self.inlines(value))
                row.add(cell)
            node.add(row)
        return node


def parse(text: str, extended: bool = True) -> Node:
    """The tree of a document. Any input gives a tree; what is malformed stays text."""
    builder = _Builder(Blocks(text, extended))
    root = builder.build(builder.blocks.root)
    notes = [x for x in root.children if x.kind == "footnote"]
    root.children = [x for x in root.children if x.kind != "footnote"] + notes + builder.notes
    return root
