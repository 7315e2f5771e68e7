"""Elements of pages, and answers in them, against a plain walk with a stack."""

import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from paperloom.kernel.capture import PROVIDERS
from paperloom.operators import elements
from paperloom.plans import structure

SF = "/root/testdata/sf0.001"


class Walk(HTMLParser):
    """The standard library's tokens and a stack of open elements."""

    CDATA_CONTENT_ELEMENTS = RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.page, self.stack, self.out, self.signs, self.n = page, [], [], 0, 0
        self.starts = [0]
        for line in page.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.raw = {}

        def blank(m):  # what holds no tags, as white space of the same length
            self.raw[m.start()] = m.end()
            return m[1] + " " * (len(m[0]) - len(m[1]))

        page = re.sub(r"(?is)(<(script|style|noscript|title|textarea|iframe)\b[^>]*>).*?(?:</\2\s*>|\Z)", blank, page)
        self.feed(page)
        self.close()
        self.pop(0, len(self.page), len(self.page))

    def here(self):
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def pop(self, kept, at, stop):
        for j, (name, i, start, signs, attrs) in enumerate(self.stack[kept:]):
            parent = self.stack[kept + j - 1] if kept + j else None
            self.out.append((name, start, stop if j == 0 else at, kept + j + 1, parent and parent[2], self.signs - signs, attrs))
        del self.stack[kept:]

    def find(self, names, walls=()):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in walls:
                return None
            if self.stack[k][0] in names:
                return k

    def handle_starttag(self, tag, attrs):
        raw, at = self.get_starttag_text(), self.here()
        names, walls = elements.CLOSES.get(tag, ((), ()))
        k = self.find(names, walls)
        if k is not None:
            self.pop(k, at, at)
        found = {}
        for a, v in attrs:
            found.setdefault(a, v or "")
        if tag in elements.VOID or tag in elements.RAW or raw.endswith("/>"):
            self.out.append((tag, at, self.raw.get(at, at + len(raw)), len(self.stack) + 1, self.stack[-1][2] if self.stack else None, 0, found))
            return
        if len(self.stack) >= elements.DEEPEST:
            self.pop(elements.DEEPEST - 1, at, at)
        self.stack.append((tag, self.n, at, self.signs, found))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        k, at = self.find([tag]), self.here()
        if k is not None:
            self.pop(k, at, self.page.index(">", at) + 1)

    def handle_data(self, data):
        self.signs += len("".join(data.split()))

    def handle_entityref(self, name):
        self.signs += name != "nbsp"

    def handle_charref(self, name):
        self.signs += name not in ("160", "xa0")


def walked(page):
    return Walk(page or "").out


def got_of(spark, texts, partitions=2):
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id int, html string").repartition(partitions)
    found = elements.element_rows(rows).collect()
    start_of = {(r.page_id, r.id): r.start for r in found}
    return {i: Counter((r.name, r.start, r.stop, r.depth, start_of.get((i, r.parent)), r.signs) for r in found if r.page_id == i) for i in range(len(texts))}


MADE = [
    None, "", "plain & text", "<p>a<p>b", "<div><p>x</div>y</p>", "<b>1<p><b>2</p></b>3", "<ul><li>a<ul><li>b</ul><li>c</ul>", "<table><tr><td>1<td>2<tr><th>3</table>", "<dl><dt>a<dd>b<dt>c</dl>", "<br/><img src=x><hr>t", "</p></div>x",
    '<a title="a>b" href=\'c\'>l</a>', "<!-- <p> --><p>&nbsp;&amp; x<!DOCTYPE html>", "<script>if (a<b) { '</p>' }</script><p>z", "<DIV Class=A>é🙂<Span>ß", "<select><option>1<option>2</select>", "<li><p>a<div>b<p>c</div>",
]


def test_elements_equal_a_plain_walk(spark):
    rnd = random.Random(1)
    made = ["".join(rnd.choice(["<p>", "</p>", "<div class=x>", "</div>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>", "t ", "<br>", "&lt;", "<section>", "</section>"]) for _ in range(rnd.randrange(80))) for _ in range(60)]
    texts = MADE + made
    got = got_of(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == Counter(x[:6] for x in walked(t)), t


def test_elements_of_all_pages_equal_a_plain_walk(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    ids = list(pages)
    got = got_of(spark, [pages[i] for i in ids], 4)
    for k, i in enumerate(ids):
        assert got[k] == Counter(x[:6] for x in walked(pages[i]))


def test_long_and_broken_pages_end_in_seconds(spark):
    texts = ["<div>" * 3000, "<p>x" * 20_000, "<a href='" * 20_000, "<!--" * 20_000, "<script>" * 20_000, "<" * 200_000, "<b " + "x='1' " * 50_000 + ">", "</p>" * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id int, html string").repartition(4)
    found = {r.page_id: (r.n, r.d) for r in elements.element_rows(rows).groupBy("page_id").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()}
    assert found == {0: (3000, 512), 1: (20_000, 1), 2: (1, 1), 4: (1, 1), 6: (1, 1)}


def plain_answer(page, provider):
    """By querySelectorAll() semantics on the walked elements."""
    found = walked(page)

    def holds(part, e):
        for attr, star, value, css_class, name in re.findall(r'\[([\w-]+)(?:(\*?)="([^"]*)")?\]|\.([\w-]+)|^([\w-]+)', part):
            v = e[6].get("class" if css_class else attr)
            if not (e[0] == name if name else v is not None and (css_class in v.split() if css_class else (value in v if star else v == value) if value else True)):
                return False
        return True

    for rank, selector in enumerate(PROVIDERS[provider][2]):
        now = [e for e in found if holds(selector.split()[0], e)]
        for part in selector.split()[1:]:
            now = [e for e in found if holds(part, e) and any(o[1] < e[1] and e[2] <= o[2] for o in now)]
        style = lambda e: e[6].get("style", "").lower().replace(" ", "")
        seen = [e for e in now if e[6].get("aria-hidden") != "true" and "display:none" not in style(e) and "visibility:hidden" not in style(e) and e[5] > 1]
        if seen:
            last = max(seen, key=lambda e: e[1])
            return provider, rank, last[1], last[2]


def test_answers_equal_plain_selectors(spark):
    pages = structure._chat_pages(spark, SF).collect()
    cut = [(r.page_id, r.url, r.html) for r in pages] + [(-1, pages[0].url, pages[0].html), (-1, pages[0].url, pages[0].html), (None, pages[1].url, pages[1].html), (-2, pages[2].url, None), (-3, None, "<article>ab</article>"), (-4, "chrome://x", "<article>ab"), (-5, "https://a.b", "<article>a</article><article> \n</article>")]
    rows = spark.createDataFrame(cut, "page_id bigint, url string, html string").withColumn("start", F.lit("clash")).withColumn("provider", F.lit("clash"))
    got = Counter((r.page_id, r.provider, r.selector, r.start, r.stop) for r in elements.answers(rows.repartition(3)).collect())
    hosts = {h: p for h, p in zip(structure.HOSTS, ["chatgpt", "claude", "gemini", "copilot", "grok", "perplexity", "deepseek", "generic"], strict=True)}
    want = Counter()
    for i, url, html in cut:
        found = None if (url or "").startswith("chrome") else plain_answer(html, hosts.get((url or "//").split("/")[2], "generic"))
        if found:
            want[(i, *found)] += 1
    assert got == want and len({(x[1], x[2]) for x in want}) >= 7


def test_answer_text(spark):
    rows = spark.createDataFrame([(1, "https://a.b", "<article>old one</article><article>a &lt;b&gt; <i>c</i>&nbsp;<script>no</script></article>")], "page_id int, url string, html string")
    assert elements.answers(rows).first().text == "a <b> c\u00a0"


@pytest.mark.parametrize("name", ["page_elements", "page_answers"])
def test_plans_stay_on_the_jvm(spark, name):
    plan = structure.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_paths_equal_a_plain_walk(spark):
    texts = [t for t in MADE if t] + ["<div>" * 40, "<ul><li><ol><li>a<li>b</ol></ul><ul>"]
    rows = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "page_id int, html string").withColumn("path", F.lit("clash")).repartition(3)
    found = elements.ancestry(rows).collect()
    for i, t in enumerate(texts):
        walk = sorted(walked(t), key=lambda e: e[1])
        by, want, among = {}, Counter(), Counter()
        for name, start, _, depth, parent, _, _ in walk:
            among[parent] += 1
            above, lists = by.get(parent, ("", 0))
            by[start] = (f"{above}/{name}".lstrip("/"), lists + (name in ("ul", "ol")))
            want[(name, depth, *by[start], among[parent])] += 1
        assert Counter((r.name, r.depth, r.path, r.list_depth, r.ordinal) for r in found if r.page_id == i) == want, t
