"""The document tree and its flat form."""

from __future__ import annotations


class Node:
    """kind, literal text, attributes and children of one element of a document."""

    __slots__ = ("attrs", "children", "kind", "literal")

    def __init__(self, kind: str, literal: str = "", **attrs):
        self.kind, self.literal, self.attrs, self.children = kind, literal, attrs, []

    def add(self, *nodes: Node) -> Node:
        self.children.extend(nodes)
        return self

    def __repr__(self):
        return f"{self.kind}({self.literal!r}, {self.attrs}, {len(self.children)} children)"


class Kept(dict):
    """What was made of short pieces that come again and again: at most so many. Nobody changes
    what is kept. It stays in its process: pickled, it is empty."""

    MOST = 4096

    def __reduce__(self):
        return Kept, ()

    def keep(self, key, value):
        if len(self) >= self.MOST:
            self.clear()
        self[key] = value
        return value


LITERALS = {"text", "code", "code_block", "math"}


def plain_text(root: Node) -> str:
    """The literals below a node; breaks count as line ends."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.kind in LITERALS:
            out.append(node.literal)
        elif node.kind in ("soft_break", "line_break"):
            out.append("\n")
        else:
            stack.extend(reversed(node.children))
    return "".join(out)


def written(root, parts) -> str:
    """The text of a tree: parts(node) says what a node is written as, a list of strings and
    further nodes. An explicit stack: trees may be of any depth."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if type(x) is str:
            out.append(x)
            continue
        made = parts(x)
        if len(made) == 1 and type(made[0]) is str:
            out.append(made[0])
        else:
            stack.extend(reversed(made))
    return "".join(out)


def flat(root: Node, full: bool = True) -> list[tuple[int, int | None, int, int, str, str, dict[str, str]]]:
    """node_id, parent_id, place among siblings, depth, kind, literal, attributes, in
    document order. Spark has no recursive types, so trees travel as such rows. full: with
    their attributes."""
    out, stack = [], [(root, None, 0, 0)]
    while stack:
        node, parent, place, depth = stack.pop()
        own = len(out)
        out.append((own, parent, place, depth, node.kind, node.literal, {} if not full else {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in node.attrs.items() if v is not None}))
        if node.children:
            stack.extend([(child, own, i, depth + 1) for i, child in enumerate(node.children)][::-1])
    return out
