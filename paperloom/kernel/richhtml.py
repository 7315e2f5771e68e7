"""Rich HTML that can be pasted into Word: every layout rule is inline."""

from __future__ import annotations

import html
import re
from bisect import bisect_left

from . import values
from .bidi import contains_rtl
from .latex import to_mathml
from .markdown import parse
from .normalise import normalised
from .tree import Node, plain_text, written

_INLINE = {"strong": "strong", "emph": "em", "strike": "del", "underline": "u", "insert": "ins", "superscript": "sup", "subscript": "sub", "highlight": "mark"}
OMITTED = "<!-- raw HTML omitted -->"


def _esc(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _href(url: str) -> str:
    return "" if re.match(r"(?:javascript|vbscript|file|data(?!:image/(?:png|gif|jpeg|webp))):", url, re.I) else _esc(url.replace(" ", "%20"))


class Writer:
    """A tree as HTML; line ends in paragraphs become breaks, raw HTML is left out. Nodes
    are written as lists of strings and further nodes, see written()."""

    def __init__(self):
        self.notes: dict[str, int] = {}
        self.tight: set[int] = set()  # paragraphs without tags around them
        self.ends: set[int] = set()  # those that end an item

    def tagged(self, tag: str, n: Node, attrs: str = "", end: str = "") -> list:
        return [f"<{tag}{attrs}>", *n.children, f"</{tag}>{end}"]

    def parts(self, n: Node) -> list:
        make = _MAKERS.get(n.kind)
        if make:
            return make(self, n)
        tag = _INLINE.get(n.kind)
        return self.tagged(tag, n) if tag else n.children

    def of_text(self, n):
        return [_esc(n.literal)]

    def of_soft_break(self, n):
        return ["<br />\n"]

    of_line_break = of_soft_break

    def of_code(self, n):
        return [f"<code>{_esc(n.literal)}</code>"]

    def of_html_inline(self, n):
        return [OMITTED]

    def of_html_block(self, n):
        return [OMITTED + "\n"]

    def of_math(self, n):
        return [f'<span data-math-style="{"display" if n.attrs["display"] else "inline"}">{_esc(n.literal)}</span>']

    def of_spoiler(self, n):
        return ['<span class="spoiler">', *n.children, "</span>"]

    def of_link(self, n):
        title = f' title="{_esc(n.attrs["title"])}"' if n.attrs["title"] else ""
        return [f'<a href="{_href(n.attrs["url"])}"{title}>', *n.children, "</a>"]

    def of_wikilink(self, n):
        return [f'<a href="{_href(n.attrs["url"])}" data-wikilink="true">', *n.children, "</a>"]

    def of_image(self, n):
        title = f' title="{_esc(n.attrs["title"])}"' if n.attrs["title"] else ""
        return [f'<img src="{_href(n.attrs["url"])}" alt="{_esc(plain_text(n))}"{title} />']

    def of_footnote_ref(self, n):
        i = self.notes.setdefault(n.attrs["name"], len(self.notes) + 1)
        name = _esc(n.attrs["name"])
        return [f'<sup class="footnote-ref"><a href="#fn-{name}" id="fnref-{name}" data-footnote-ref>{i}</a></sup>']

    def of_task_mark(self, n):
        return [self.box(n.attrs["checked"])]

    @staticmethod
    def box(checked: bool) -> str:
        return '<input type="checkbox" ' + ('checked="" ' if checked else "") + 'disabled="" />'

    def of_paragraph(self, n):
        if len(n.children) == 1 and n.children[0].kind == "image" and n.children[0].attrs["title"]:
            return ["<figure>", *n.children, f"<figcaption>{_esc(n.children[0].attrs['title'])}</figcaption></figure>" + ("" if id(n) in self.ends else "\n")]
        if id(n) in self.tight:
            return [*n.children, "" if id(n) in self.ends else "\n"]
        return self.tagged("p", n, end="\n")

    def of_heading(self, n):
        return self.tagged(f"h{n.attrs['level']}", n, end="\n")

    def of_subtext(self, n):
        return ["<p><sub>", *n.children, "</sub></p>\n"]

    def of_rule(self, n):
        return ["<hr />\n"]

    def of_code_block(self, n):
        info = (n.attrs["info"].split() or [""])[0]
        language = f' class="language-{_esc(info)}"' if info else ""
        return [f"<pre><code{language}>{_esc(n.literal)}</code></pre>\n"]

    def of_quote(self, n):
        return ["<blockquote>\n", *n.children, "</blockquote>\n"]

    of_multiline_quote = of_quote

    def of_alert(self, n):
        name = n.attrs["type"]
        return [f'<div class="markdown-alert markdown-alert-{name}">\n<p class="markdown-alert-title">{_esc(n.attrs["title"] or name.capitalize())}</p>\n', *n.children, "</div>\n"]

    def of_list(self, n):
        tag, start = ("ol", n.attrs["start"]) if n.attrs["ordered"] else ("ul", None)
        tasks = ' class="contains-task-list"' if any(c.kind == "task_item" for c in n.children) else ""
        first = f' start="{start}"' if start not in (None, 1) else ""
        if n.attrs["tight"]:
            for item in n.children:
                plain = [c for c in item.children if c.kind == "paragraph"]
                self.tight.update(map(id, plain))
                self.ends.update(map(id, item.children[-1:] if plain and plain[-1] is item.children[-1] else []))
        return [f"<{tag}{first}{tasks}>\n", *n.children, f"</{tag}>\n"]

    def of_item(self, n):
        begin = "" if n.children and id(n.children[0]) in self.tight else "\n"
        return [f"<li>{begin}", *n.children, "</li>\n"]

    def of_task_item(self, n):
        return [f'<li class="task-list-item">{self.box(n.attrs["checked"])} ', *n.children, "</li>\n"]

    def of_table(self, n):
        head, *rows = n.children
        return ["<table>\n<thead>\n", head, "</thead>\n", *(["<tbody>\n", *rows, "</tbody>\n"] if rows else []), "</table>\n"]

    def of_table_row(self, n):
        tag, out = "th" if n.attrs["header"] else "td", ["<tr>\n"]
        for c in n.children:
            side = f' align="{c.attrs["side"]}"' if c.attrs.get("side") else ""
            out += self.tagged(tag, c, side, "\n")
        return [*out, "</tr>\n"]

    def of_description_list(self, n):
        return ["<dl>\n", *n.children, "</dl>\n"]

    def of_description_term(self, n):
        return self.tagged("dt", n, end="\n")

    def of_description_details(self, n):
        return ["<dd>\n", *n.children, "</dd>\n"]

    def document(self, root: Node) -> str:
        body = "".join(written(n, self.parts) for n in root.children if n.kind != "footnote")
        notes = {n.attrs["name"]: n for n in root.children if n.kind == "footnote"}
        used = [notes[name] for name in self.notes if name in notes]
        if not used:
            return body
        items = "".join(f'<li id="fn-{_esc(n.attrs["name"])}">\n{"".join(written(c, self.parts) for c in n.children)}</li>\n' for n in used)
        return f'{body}<section class="footnotes" data-footnotes>\n<ol>\n{items}</ol>\n</section>\n'


#: How each kind is written.
_MAKERS = {name[3:]: make for name, make in vars(Writer).items() if name.startswith("of_")}


def directed_tables(page: str) -> str:
    """Tables with right-to-left text are marked so; an unclosed one ends the search."""
    mark = lambda m: m[0].replace("<table>", '<table dir="rtl">', 1) if contains_rtl(m[0]) else m[0]
    return re.sub("<table>.*?</table>", mark, page, flags=re.S)


def with_math(page: str) -> str:
    if "<span data-math-style=" not in page:
        return page
    return re.sub(r'<span data-math-style="(inline|display)">(.*?)</span>', lambda m: to_mathml(html.unescape(m[2]), m[1] == "display"), page, flags=re.S)


_BARE = re.compile("|".join(map(re.escape, [*(bare for bare, _ in values.TAG_STYLES), *(f"<h{level}>" for level in values.HEADINGS), '<code class="'])))
_STYLES = {**dict(values.TAG_STYLES), **{f"<h{level}>": values.heading_tag(level) for level in values.HEADINGS}, '<code class="': values.CODE_CLASS}
_LTR_QUOTE = values.QUOTE_RTL.replace('dir="auto"', 'dir="ltr"')
_FLIPPED = _LTR_QUOTE.replace("border-right:1.75pt solid #5b7fa3;border-left:0;", "border-left:1.75pt solid #5b7fa3;border-right:0;")
#: The same where a page has no right-to-left sign, so that all directions are known.
_LTR_STYLES = {bare: full.replace(' dir="auto"', ' dir="ltr"').replace(_LTR_QUOTE, _FLIPPED) for bare, full in _STYLES.items()}


def styled(page: str, styles: dict[str, str] = _STYLES) -> str:
    """Bare tags get their inline styles, in one pass."""
    return _BARE.sub(lambda m: styles[m[0]], page)


def banded(page: str) -> str:
    """Every second row of each table body gets a background."""

    def body(m) -> str:
        first, *rows = m[2].split("<tr>")
        return m[1] + first + "".join(("<tr>" if i % 2 == 0 else '<tr style="background:#f8fafc;">') + r for i, r in enumerate(rows)) + m[3]

    return re.sub("(<tbody>)(.*?)(</tbody>)", body, page, flags=re.S) if "<tbody>" in page else page


def resolved(page: str) -> str:
    """Each dir="auto" follows the text up to the first closing tag of the same name; an
    element that is never closed counts as empty."""
    out, at, ends, rtl_at = [], 0, {}, [m.start() for m in re.finditer("[\u0590-\u08ff]", page)]
    for m in re.finditer(r"</[A-Za-z0-9]+>", page):
        ends.setdefault(m[0][2:-1], []).append(m.start())
    for m in re.finditer(r'<([A-Za-z0-9]+) dir="auto"', page):
        start = page.find(">", m.end()) + 1
        closing, i = ends.get(m[1], []), bisect_left(rtl_at, start)
        end = bisect_left(closing, start)
        rtl = end < len(closing) and i < len(rtl_at) and rtl_at[i] < closing[end]
        out.append(page[at : m.end() - 5] + ("rtl" if rtl else "ltr"))
        at = m.end() - 1
    return "".join(out) + page[at:]


def wrapped(page: str, rtl: bool) -> str:
    side = "rtl" if rtl else "ltr"
    style = f"font-family:{values.FONT},sans-serif;font-size:{values.points(values.BODY_SIZE, 2)}pt;line-height:1.15;color:#{values.BODY_COLOR.lower()};background:#ffffff;max-width:100%;"
    return f'<!--StartFragment--><div class="paperloom" dir="{side}" style="{style}">{page}</div><!--EndFragment-->'


def rich_html(markdown: str, extended: bool = True) -> str:
    page = Writer().document(parse(normalised(markdown), extended))
    if not contains_rtl(page):  # nothing later makes such signs
        return wrapped(banded(styled(with_math(page), _LTR_STYLES)), False)
    page = resolved(banded(styled(with_math(directed_tables(page)))))
    return wrapped(page.replace(_LTR_QUOTE, _FLIPPED), contains_rtl(page))
