"""Queries over the structure of pages and texts, with SQL that finds it by other means:
recursion over tags, lists and running sums."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from paperloom.functions import dialect
from paperloom.functions import directions
from paperloom.kernel.capture import PROVIDERS
from paperloom.operators import audit, chat, elements, isolates, manifests, skeleton
from paperloom.sources import sinks
from paperloom.sources.files import spread

from .base import MIXED_SQL, QUERIES, RICH_SQL, docs, mixed, pages, query, rich, sql, turns  # noqa: F401

#: Chat markup around a page, so that selectors of every provider have something to find.
CHAT = [
    '<div data-message-author-role=assistant><div class="markdown a">first</div></div><model-response><message-content>m1</message-content></model-response><cib-message-group source="bot"><cib-message>c1<cib-message aria-hidden="true">hidden c2</cib-message></cib-message-group>'
    '<div data-testid="message-bubble"><p class="prose">',
    "</div><section class=\"prose ds-markdown\" style=\"color:red; Display : none\">no</section><div data-is-streaming><div class=\"x\tprose\">s1 <b>un</div></div><div data-testid='answer'>x</div><div data-content=\"ai-message\">&nbsp;x</div><div class=\"prose\">last &amp; one",
]
#: A host of each provider, by the number of the page.
HOSTS = ["chatgpt.com", "claude.ai", "gemini.google.com", "copilot.microsoft.com", "grok.com", "perplexity.ai", "chat.deepseek.com", "a.example"]


def _chat_pages(spark, sf_dir):
    host = F.get(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % len(HOSTS)).cast("int"))
    return spread(pages(spark, sf_dir)).select("page_id", F.concat(F.lit("https://"), host, F.lit("/c")).alias("url"), F.concat(F.lit(CHAT[0]), F.coalesce("html", F.lit("")), F.lit(CHAT[1])).alias("html"))


def _list(values) -> str:
    return "[" + ", ".join(sql(v) for v in values) + "]"


def _elements_sql(source: str) -> str:
    """CTEs that end in e: the elements of the pages of `source` (page_id, url, html)."""
    tag, shown = sql(elements.tag_pattern("")), lambda x: f"length(regexp_replace(regexp_replace(regexp_replace({x}, '{elements.NBSP}', ' ', 'g'), '{elements.ENTITY}', 'x', 'g'), '{elements.SPACE}', '', 'g'))"
    rules = " ".join(f"WHEN {sql(k)} THEN {{'t': {_list(t)}, 'w': {_list(w)}}}" for k, (t, w) in elements.CLOSES.items())
    last = lambda names: f"coalesce(list_max(list_transform(stack, lambda e, j: CASE WHEN list_contains({names}, e.name) THEN j END)), 0)"
    ended = lambda stack, kept, at, stop, seen: f"list_transform({stack}[{kept} + 1:], lambda e, j: {{'id': e.id, 'name': e.name, 'start': e.start, 'stop': CASE WHEN j = 1 THEN {stop} ELSE {at} END, 'depth': {kept} + j, 'parent': {stack}[{kept} + j - 1].id, 'signs': {seen} - e.seen}})"
    kind = "STRUCT(id BIGINT, name VARCHAR, start BIGINT, stop BIGINT, depth BIGINT, parent BIGINT, signs BIGINT)[]"
    return f"""RECURSIVE p AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(html, '') AS h FROM {source}),
c AS (SELECT r, length(h) AS n, regexp_split_to_array(h, {tag}) AS pieces, regexp_extract_all(h, {tag}) AS tags FROM p),
x1 AS (SELECT r, i, tags[i + 1] AS tag, pieces[i + 1] AS piece, lower(regexp_extract(tags[i + 1], '{elements.NAME}', 1)) AS name, tags[i + 1][2] = '/' AS ends FROM (SELECT *, unnest(range(len(tags))) AS i FROM c)),
x2 AS (SELECT *, CASE name {rules} ELSE {{'t': []::VARCHAR[], 'w': []::VARCHAR[]}} END AS rule, list_contains({_list(['', *elements.VOID, *elements.RAW])}, name) OR tag[-2:] = '/>' AS alone, sum(length(piece)) OVER o + coalesce(sum(length(tag)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, sum({shown('piece')}) OVER o AS seen FROM x1 WINDOW o AS (PARTITION BY r ORDER BY i)),
x AS MATERIALIZED (SELECT r, i, name, ends, alone, pos::BIGINT AS pos, (pos + length(tag))::BIGINT AS past, seen::BIGINT AS seen, CASE WHEN ends THEN [name] ELSE rule.t END AS targets, CASE WHEN ends THEN [] ELSE rule.w END AS walls FROM x2),
s(r, i, stack, out) AS (SELECT r, -1::BIGINT, []::STRUCT(name VARCHAR, id BIGINT, start BIGINT, seen BIGINT)[], []::{kind} FROM p
  UNION ALL SELECT r, i, CASE WHEN ends OR alone THEN stack[:kept] ELSE list_append(stack[:kept], {{'name': name, 'id': i, 'start': pos, 'seen': seen}}) END,
    list_concat({ended('stack', 'kept', 'pos', '(CASE WHEN ends THEN past ELSE pos END)', 'seen')}, CASE WHEN alone AND NOT ends THEN [{{'id': i, 'name': name, 'start': pos, 'stop': past, 'depth': kept + 1, 'parent': stack[kept].id, 'signs': 0}}] ELSE [] END)::{kind}
  FROM (SELECT *, CASE WHEN ends OR alone THEN k ELSE least(k, {elements.DEEPEST - 1}) END AS kept FROM (SELECT s.r, x.i, stack, name, ends, alone, pos, past, seen, CASE WHEN {last('targets')} > {last('walls')} THEN {last('targets')} - 1 ELSE len(stack) END AS k FROM s JOIN x ON x.r = s.r AND x.i = s.i + 1))),
z AS (SELECT s.r, stack, n, coalesce((SELECT sum({shown('v')}) FROM (SELECT unnest(pieces) AS v)), 0)::BIGINT AS seen FROM s JOIN c ON c.r = s.r AND s.i = len(c.tags) - 1),
e AS MATERIALIZED (SELECT p.page_id, p.url, q.r, e.*, tags[e.id + 1] AS tag FROM (SELECT r, unnest(out) AS e FROM s UNION ALL SELECT r, unnest({ended('stack', '0', 'n', 'n', 'seen')}) AS e FROM z) q JOIN p ON p.r = q.r JOIN c ON c.r = q.r WHERE e.name <> '')"""


@query(f"WITH {_elements_sql('pages')} SELECT page_id, CAST(id AS INT) AS id, name, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, CAST(depth AS INT) AS depth, CAST(parent AS INT) AS parent, CAST(signs AS INT) AS signs FROM e")
def page_elements(spark, sf_dir):
    return elements.element_rows(spread(pages(spark, sf_dir)).select("page_id", "html")).drop("tag")


@query(f"""WITH {_elements_sql('pages')},
n AS MATERIALIZED (SELECT r, page_id, id, name, depth, parent, row_number() OVER (PARTITION BY r, parent ORDER BY start) AS ordinal FROM e),
w(r, page_id, id, name, depth, path, lists, ordinal) AS (SELECT r, page_id, id, name, depth, name, CASE WHEN name IN ('ul', 'ol') THEN 1 ELSE 0 END, ordinal FROM n WHERE parent IS NULL
  UNION ALL SELECT n.r, n.page_id, n.id, n.name, n.depth, w.path || '/' || n.name, w.lists + CASE WHEN n.name IN ('ul', 'ol') THEN 1 ELSE 0 END, n.ordinal FROM w JOIN n ON n.r = w.r AND n.parent = w.id)
SELECT page_id, CAST(id AS INT) AS id, name, CAST(depth AS INT) AS depth, path, CAST(lists AS INT) AS list_depth, CAST(ordinal AS INT) AS ordinal FROM w""")
def element_paths(spark, sf_dir):
    return elements.ancestry(spread(pages(spark, sf_dir)).select("page_id", "html"))


def _holds(part: str) -> str:
    out = []
    for attr, star, value, css_class, name in re.findall(r'\[([\w-]+)(?:(\*?)="([^"]*)")?\]|\.([\w-]+)|^([\w-]+)', part):
        if name:
            out.append(f"name = '{name}'")
        elif css_class:
            out.append(f"contains(' ' || regexp_replace(a['class'], '[\\t\\n\\f\\r ]', ' ', 'g') || ' ', ' {css_class} ')")
        else:
            out.append(f"a['{attr}'] IS NOT NULL" if not value else f"contains(a['{attr}'], '{value}')" if star else f"a['{attr}'] = '{value}'")
    return " AND ".join(out)


def _answers_sql(source: str) -> str:
    head, attribute = sql(elements.HEAD.replace("*+", "*")), sql(elements.ATTRIBUTE.replace("++", "+"))
    host = "regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"
    provider = "CASE " + " ".join(f"WHEN regexp_matches({host}, '{'|'.join(v[1])}') THEN '{k}'" for k, v in PROVIDERS.items() if v[1]) + " ELSE 'generic' END"
    parts = [(p, rank, k, len(s.split()) - 1, part) for p, (_, _, selectors) in PROVIDERS.items() for rank, s in enumerate(selectors) for k, part in enumerate(s.split())]
    hits = " UNION ALL ".join(f"SELECT r, provider, id, start, stop, signs, seen, {rank} AS rank, {k} AS step, {last} AS last FROM m WHERE provider = '{p}' AND {_holds(part)}" for p, rank, k, last, part in parts)
    value = lambda n: f"CASE WHEN list_contains(k, '{n}') THEN coalesce(regexp_replace(v[list_position(k, '{n}')], '^[\"'']|[\"'']$', '', 'g'), '') END"
    read = elements._READ
    style = "regexp_replace(lower(coalesce(a['style'], '')), '[\\t\\n\\f\\r ]', '', 'g')"
    text = f"regexp_replace(substr(h, start + 1, stop - start), {sql(elements.tag_pattern(''))}, '', 'g')"
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{sign}')"
    return f"""WITH {_elements_sql(source)},
n AS (SELECT *, [lower(y) FOR y IN regexp_extract_all(g, {attribute}, 1)] AS k, regexp_extract_all(g, {attribute}, 2) AS v FROM (SELECT *, regexp_extract(tag, {head}, 1) AS g FROM e WHERE NOT regexp_matches(lower(coalesce(url, '')), '^(chrome|edge|about|view-source):'))),
m0 AS (SELECT r, id, name, start, stop, signs, {provider} AS provider, MAP {{{', '.join(f"'{n}': {value(n)}" for n in read)}}} AS a FROM n),
m AS MATERIALIZED (SELECT *, NOT (coalesce(a['aria-hidden'] = 'true', false) OR contains({style}, 'display:none') OR contains({style}, 'visibility:hidden')) AS seen FROM m0),
h AS MATERIALIZED ({hits}),
o AS (SELECT * FROM h WHERE seen AND signs > 1 AND step = last AND (step = 0 OR EXISTS (SELECT 1 FROM h g WHERE g.r = h.r AND g.rank = h.rank AND g.step = 0 AND g.start < h.start AND g.stop >= h.stop))),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY r ORDER BY rank, start DESC) = 1)
SELECT p.page_id, b.provider, CAST(rank AS INT) AS selector, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, sha256({text}) AS text_sha256 FROM b JOIN p ON p.r = b.r"""


def _answers(found):
    return found.select("page_id", "provider", "selector", "start", "stop", F.sha2("text", 256).alias("text_sha256"))


@query(_answers_sql("pages"))
def page_answers(spark, sf_dir):
    return _answers(elements.answers(spread(pages(spark, sf_dir))))


_HOSTS_SQL = "[" + ", ".join(sql(h) for h in HOSTS) + "]"


@query(_answers_sql(f"(SELECT page_id, 'https://' || {_HOSTS_SQL}[page_id % {len(HOSTS)} + 1] || '/c' AS url, {sql(CHAT[0])} || coalesce(html, '') || {sql(CHAT[1])} AS html FROM pages)"))
def chat_page_answers(spark, sf_dir):
    return _answers(elements.answers(_chat_pages(spark, sf_dir)))


#: Arrows, code, formulas and Hebrew after each sentence, and a fence at the end.
ARROWS = ["([.!?]) ", " א → `→` $x→ \\\\→ ← ", "\n→ א\n```\n→ ב\n ~~~ x\nג → ד"]


def _arrows():
    return F.concat(F.regexp_replace(mixed(), ARROWS[0], "$1" + ARROWS[1].replace("$", "\\$")), F.lit(ARROWS[2]))


_FOLDED = r"regexp_replace(replace(regexp_replace({}, '([\x{{0590}}-\x{{05FF}}])-([A-Za-z])', '\1־\2', 'g'), '—', '-'), '[\x{{200E}}\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]', '', 'g')"
_RTL = r"[\x{0590}-\x{08FF}]"
_ISLAND = sql(directions.ISLAND.replace("*+", "*"))
_FENCE = r"^[\s\x{A0}\x{2000}-\x{200A}\x{3000}]*(?:```|~~~)"


@query(rf"""WITH d AS (SELECT doc_id, string_split({_FOLDED.format(f"(regexp_replace({MIXED_SQL}, '{ARROWS[0]}', {sql(chr(92) + '1' + ARROWS[1])}, 'g') || {sql(ARROWS[2])})")}, chr(10)) AS l FROM documents),
m AS (SELECT doc_id, list_transform(l, lambda x, i: CASE WHEN regexp_matches(x, '[→←]') AND regexp_matches(x, '{_RTL}') AND NOT regexp_matches(x, '{_FENCE}') AND len(list_filter(l[:i - 1], lambda y: regexp_matches(y, '{_FENCE}'))) % 2 = 0
  THEN array_to_string(list_transform(regexp_split_to_array(x, {_ISLAND}), lambda p, k: translate(p, '→←', '←→') || coalesce(regexp_extract_all(x, {_ISLAND})[k], '')), '') ELSE x END) AS l FROM d)
SELECT doc_id, sha256(array_to_string(l, chr(10))) AS normalised_sha256 FROM m""")
def normalize_arrows(spark, sf_dir):
    text = directions.normalised(_arrows())
    return spread(docs(spark, sf_dir)).select("doc_id", F.sha2(text, 256).alias("normalised_sha256"))


#: Hebrew with brackets and quotes wherever a sentence or a clause ends.
TURNS = ["([.,]) ", " (שלום) [a ב \"c\" "]
_TURNS_SQL = f"regexp_replace({MIXED_SQL}, '{TURNS[0]}', {sql(chr(92) + '1' + TURNS[1])}, 'g')"
_TAIL = lambda c: f"string_split(x, {sql(c)})[-1]"
_FIRST = "list_min([" + ", ".join([f"CASE WHEN strpos({_TAIL(c)}, {sql(o)}) > 0 THEN length(x) - length({_TAIL(c)}) + strpos({_TAIL(c)}, {sql(o)}) - 1 END" for o, c in directions._PAIRS] + [f"CASE WHEN contains(x, {sql(o)}) THEN strpos(x, {sql(o)}) - 1 END" for o in directions._ALWAYS]) + "])"
_CORE = r"'\x01+(?:\x03*\x01+)*|\x02+(?:\x03*\x02+)*'"


@query(rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TURNS_SQL} AS t FROM documents),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '{_RTL}', chr(1), 'g'), '\p{{L}}', chr(2), 'g'), '[^\x01\x02]', chr(3), 'g') AS k FROM d),
b AS (SELECT r, doc_id, t, 2 * length(regexp_replace(k, '[^\x01]', '', 'g')) > length(regexp_replace(k, '\x03', '', 'g')) AS base, regexp_extract_all(k, {_CORE}) AS cores, regexp_split_to_array(k, {_CORE}) AS gaps FROM k),
i AS (SELECT *, cores[j] AS core, gaps[j] AS gap FROM (SELECT *, unnest(range(1, len(cores) + 1)) AS j FROM b)),
p AS (SELECT *, core[1] = chr(1) AS rtl, lag(core[1] = chr(1)) OVER (PARTITION BY r ORDER BY j) AS was, sum(length(gap) + length(core)) OVER (PARTITION BY r ORDER BY j) - length(core) AS pos FROM i),
x AS (SELECT *, substr(t, (pos - length(gap))::BIGINT + 1, length(gap)) AS x FROM p),
c AS (SELECT *, CASE WHEN j = 1 THEN 0 WHEN was <> base AND rtl = base THEN pos - length(gap) + length(regexp_replace(left(x, coalesce({_FIRST}, length(x))), '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '')) ELSE pos - length(gap) + coalesce({_FIRST}, length(x)) END AS start FROM x),
s AS (SELECT doc_id, t, j, rtl, start::BIGINT AS start, coalesce(lead(start) OVER (PARTITION BY r ORDER BY j), length(t))::BIGINT AS stop FROM c)
SELECT doc_id, CAST(j - 1 AS INT) AS place, rtl, sha256(substr(t, start + 1, stop - start)) AS text_sha256 FROM s""")
def direction_segments(spark, sf_dir):
    turned = F.regexp_replace(mixed(), TURNS[0], "$1" + TURNS[1])
    rows = directions.segment_rows(spread(docs(spark, sf_dir)).select("doc_id", turned.alias("text")))
    return rows.select("doc_id", "place", "rtl", F.sha2("text", 256).alias("text_sha256"))


#: Items and quotes where sentences and clauses end, so that every text has blocks.
BROKEN = [("([.]) ", "\n- "), ("(,) ", "\n  - > "), ("([?!]) ", "\n> > ")]


def _broken_rich(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    for pattern, by in BROKEN:
        text = F.regexp_replace(text, pattern, "$1" + by)
    return rich(spread(docs(spark, sf_dir)).withColumn("text", text)).select("doc_id", "text")


def _blocks_sql() -> str:
    text = "coalesce(text, '')"
    for pattern, by in BROKEN:
        text = f"regexp_replace({text}, '{pattern}', {sql(chr(92) + '1' + by)}, 'g')"
    plain = lambda p: sql(p.replace("*+", "*").replace("++", "+").replace("}+", "}").replace("?+", "?"))
    half = skeleton.LONGEST - 2
    step = f"CASE WHEN s = 0 THEN own WHEN (s <= {half}) = (own <= {half}) AND own >= s THEN 0 ELSE s END"
    end = "'\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]'"
    island = lambda kind, order: f"{order} - dense_rank() OVER (PARTITION BY r, d ORDER BY n)"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex({RICH_SQL.replace("coalesce(text, '')", "t")}, {end}) AS l FROM (SELECT *, {text} AS t FROM documents)),
c AS (SELECT r, doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM d),
x AS (SELECT r, doc_id, len(l) AS total, i AS n, l[i + 1] AS x, CASE WHEN i > 0 THEN l[i] ELSE '' END AS p FROM (SELECT *, unnest(range(len(l))) AS i FROM c)),
f AS MATERIALIZED (SELECT *, CASE WHEN m = '' THEN 0 ELSE least(length(m), {skeleton.LONGEST}) - 2 + CASE WHEN m[1] = '~' THEN {half} ELSE 0 END END AS own FROM (SELECT *, regexp_extract(x, {plain(skeleton.FENCE)}, 1) AS m FROM x)),
e AS MATERIALIZED (SELECT r, n, own, row_number() OVER (PARTITION BY r ORDER BY n) AS e FROM f WHERE own > 0),
s(r, e, s) AS (SELECT r, 0::BIGINT, 0 FROM d UNION ALL SELECT s.r, e.e, {step} FROM s JOIN e ON e.r = s.r AND e.e = s.e + 1),
g AS (SELECT f.*, s.s AS after FROM f LEFT JOIN e ON e.r = f.r AND e.n = f.n LEFT JOIN s ON s.r = e.r AND s.e = e.e),
h AS (SELECT *, coalesce(last_value(after IGNORE NULLS) OVER (PARTITION BY r ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
o AS (SELECT *, before = 0 AND own = 0 AS free, regexp_matches(x, {plain(skeleton.ITEM)}) AS item, regexp_matches(x, {plain(skeleton.BLANK)}) AS blank, length(replace(regexp_extract(x, '^[ \t]*'), chr(9), '    ')) AS indent FROM h),
q AS MATERIALIZED (SELECT *, sum(CASE WHEN NOT free OR (NOT blank AND NOT item AND indent < 2) THEN 1 ELSE 0 END) OVER w AS b, sum(CASE WHEN free AND item THEN 1 ELSE 0 END) OVER w AS k FROM o WINDOW w AS (PARTITION BY r ORDER BY n)),
fences AS (SELECT doc_id, 'fence' AS kind, n AS lo, coalesce(z, total - 1) AS hi, 1 AS d FROM (SELECT *, lead(n) OVER (PARTITION BY r ORDER BY n) AS z FROM q WHERE (before = 0 AND own > 0) OR (before > 0 AND after = 0)) WHERE before = 0),
heads AS (SELECT doc_id, 'heading' AS kind, n AS lo, n AS hi, length(regexp_extract(x, {plain(skeleton.ATX)}, 1)) AS d FROM q WHERE free AND regexp_matches(x, {plain(skeleton.ATX)})
  UNION ALL SELECT doc_id, 'heading', n - 1, n, CASE WHEN contains(x, '=') THEN 1 ELSE 2 END FROM q WHERE free AND regexp_matches(x, {plain(skeleton.UNDER)}) AND NOT regexp_matches(p, {plain(skeleton.BLANK)}) AND NOT regexp_matches(p, {plain(skeleton.FENCE)})),
ql AS (SELECT *, unnest(range(1, least(length(regexp_replace(regexp_extract(x, {plain(skeleton.QUOTE)}), '[^>]', '', 'g')), {skeleton.DEEPEST}) + 1)) AS d FROM q WHERE free),
il AS (SELECT *, unnest(range(1, CAST(least(1 + indent // 2, {skeleton.DEEPEST}) AS BIGINT) + 1)) AS d FROM q WHERE free AND item),
quotes AS (SELECT doc_id, 'quote' AS kind, min(n) AS lo, max(n) AS hi, d FROM (SELECT *, {island('quote', 'n')} AS g FROM ql) GROUP BY r, doc_id, d, g),
lists AS (SELECT doc_id, 'list' AS kind, min(n) AS lo, max(n) AS hi, d FROM (SELECT *, {island('list', 'k')} AS g FROM il) GROUP BY r, doc_id, d, g, b),
pipes AS (SELECT *, n - row_number() OVER (PARTITION BY r ORDER BY n) AS g, regexp_matches(x, {plain(skeleton.RULE)}) AS rule FROM q WHERE free AND contains(x, '|')),
tables AS (SELECT doc_id, 'table' AS kind, min(CASE WHEN rule AND n > first THEN n END) - 1 AS lo, max(n) AS hi, 1 AS d FROM (SELECT *, min(n) OVER (PARTITION BY r, g) AS first FROM pipes) GROUP BY r, doc_id, g HAVING lo IS NOT NULL)
SELECT doc_id, kind, CAST(lo AS BIGINT) AS first_line, CAST(hi AS BIGINT) AS last_line, CAST(d AS INT) AS depth FROM (SELECT * FROM fences UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM quotes UNION ALL SELECT * FROM lists UNION ALL SELECT * FROM tables)"""


@query(_blocks_sql())
def text_blocks(spark, sf_dir):
    return skeleton.blocks(_broken_rich(spark, sf_dir))


#: Isolate marks where clauses and sentences end: pairs, nests, strays and open ones.
MARKS = [("(,) ", " \u2066"), ("([.]) ", "\u2069 "), ("([?!]) ", " \u2066a\u2069\u2069")]


def _marked_sql() -> str:
    text = MIXED_SQL
    for pattern, by in MARKS:
        text = f"regexp_replace({text}, '{pattern}', '\\1{by}', 'g')"
    return text


@query(f"""WITH t AS (SELECT doc_id, {_marked_sql()} AS t FROM documents),
m AS (SELECT doc_id, i, CASE WHEN c = '\u2066' THEN 1 ELSE -1 END AS s, p FROM (SELECT doc_id, generate_subscripts(string_split(t, ''), 1) AS p, unnest(string_split(t, '')) AS c, row_number() OVER (PARTITION BY doc_id) AS i FROM t) WHERE c IN ('\u2066', '\u2069')),
d AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY p) AS d FROM m),
l AS (SELECT *, d - least(0, min(d) OVER (PARTITION BY doc_id ORDER BY p)) AS up, least(0, min(d) OVER (PARTITION BY doc_id ORDER BY p)) < least(0, coalesce(min(d) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stray FROM d),
o AS (SELECT *, s = 1 AND NOT EXISTS (SELECT 1 FROM l z WHERE z.doc_id = l.doc_id AND z.p > l.p AND z.up < l.up) AND NOT EXISTS (SELECT 1 FROM l z WHERE z.doc_id = l.doc_id AND z.p > l.p AND z.stray) AS unclosed FROM l),
g AS (SELECT doc_id, count(*) FILTER (s = 1 AND NOT unclosed) AS pairs, count(*) FILTER (s = 1 AND up > 1) AS nested, count(*) FILTER (stray) AS stray, count(*) FILTER (unclosed) AS unclosed, min(CASE WHEN stray OR unclosed OR (s = 1 AND up > 1) THEN p - 1 END) AS first FROM o GROUP BY doc_id)
SELECT t.doc_id, coalesce(pairs, 0)::BIGINT AS pairs, coalesce(nested, 0)::BIGINT AS nested, coalesce(stray, 0)::BIGINT AS stray, coalesce(unclosed, 0)::BIGINT AS unclosed, first::INT AS first_fault, first IS NULL AS balanced FROM t LEFT JOIN g USING (doc_id)""")
def isolate_balance(spark, sf_dir):
    text = mixed()
    for pattern, by in MARKS:
        text = F.regexp_replace(text, pattern, "$1" + by)
    return isolates.isolate_balance(spread(docs(spark, sf_dir)).select("doc_id", text.alias("text")))


def _body():
    """Answers of eight shapes, by the turn; the text of the turn is in each."""
    text, one = F.coalesce("text", F.lit("")), F.lit("x")
    typed = lambda t, kind="text": F.struct(F.lit(kind).alias("type"), t.alias("text"))
    shapes = [
        F.struct(text.alias("output_text"), F.lit(1).alias("content")), F.struct(F.array(F.struct(F.array(typed(text, "output_text"), typed(one, "reasoning"), typed(one)).alias("content"))).alias("output"), F.lit(None).cast("string").alias("output_text")),
        F.struct(F.array(typed(text), typed(one, "tool"), typed(one)).alias("content")), F.struct(text.alias("content")),
        F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text")), F.struct(one.alias("text"))).alias("parts")).alias("content"))).alias("candidates")),
        F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")), F.struct(F.struct(F.array(text, one).alias("content")).alias("message"), F.lit(2.5).alias("text")),
    ]
    turn, made = F.col("turn") % (len(shapes) + 1), F.concat(F.lit("{no json "), text)
    for i, shape in enumerate(shapes):
        made = F.when(turn == i, F.to_json(shape)).otherwise(made)
    return made


@query("""SELECT conv_id, turn, CASE turn % 8 WHEN 7 THEN NULL WHEN 1 THEN coalesce(text, '') || chr(10) || 'x' WHEN 2 THEN coalesce(text, '') || chr(10) || 'x' WHEN 4 THEN coalesce(text, '') || 'x' WHEN 6 THEN coalesce(text, '') || chr(10) || 'x' ELSE coalesce(text, '') END AS text FROM conversations""")
def answers_of_any_shape(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", chat.answer_of(_body()).alias("text"))


@query("""WITH t AS (SELECT conv_id, CASE turn % 8 WHEN 7 THEN NULL ELSE to_json({'text': text, 'turn': turn}) END AS body FROM conversations)
SELECT conv_id, count(*) AS n, count(json_extract_string(body, '$.text')) > 0 AS has_text FROM t GROUP BY conv_id""")
def answer_shapes(spark, sf_dir):
    body = F.when(F.col("turn") % 8 != 7, F.to_json(F.struct("text", "turn")))
    found = chat.shapes(turns(spark, sf_dir).select("conv_id", body.alias("body")), "body", "conv_id")
    return found.select("conv_id", "n", F.contains("shape", F.lit("text: STRING")).alias("has_text"))


#: Terms of which some lie in others, or overlap; expected pages; links of each text.
TERMS = ["casino", "asin", "free-bets", "bets.example", "machine", "tion", "action"]


@query(f"""WITH f AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, text || CASE WHEN doc_id % 50 = 0 THEN ' C:\\Users\\bob\\x' ELSE '' END AS text FROM documents UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages),
s AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, doc_id, source FROM documents)
SELECT path, 'banned' AS finding, term AS detail FROM f, (SELECT unnest([{', '.join(map(sql, TERMS))}]) AS term) WHERE contains(lower(text), term)
UNION ALL SELECT path, 'machine_path', 'C:\\Users\\bob' FROM s WHERE doc_id % 50 = 0
UNION ALL SELECT path, 'broken_link', '../' || source || '/.//' || (doc_id + 1) || '.md' FROM s WHERE 'docs/' || source || '/' || (doc_id + 1) || '.md' NOT IN (SELECT path FROM s)
UNION ALL SELECT path, 'broken_link', '../../x/../pages/' || (doc_id % 300) || '.html' FROM s WHERE doc_id % 300 NOT IN (SELECT page_id FROM pages)
UNION ALL SELECT path, 'broken_link', '../../../docs' FROM s
UNION ALL SELECT 'shots/' || page_id || '.png', 'image', CASE WHEN page_id % 4 = 0 THEN 'no PNG' ELSE (800 + page_id) || 'x' || 300 END FROM pages WHERE page_id % 4 = 0 OR page_id < 200
UNION ALL SELECT 'pages/' || (page_id * 2) || '.html', 'missing', NULL FROM pages WHERE page_id * 2 NOT IN (SELECT page_id FROM pages)
UNION ALL SELECT 'pages/' || page_id || '.html', 'unexpected', NULL FROM pages WHERE page_id NOT IN (SELECT page_id * 2 FROM pages)""")
def repository_audit(spark, sf_dir):
    """Texts and pages as the files of a repository, with a picture of each page."""
    id, page, empty = F.col("doc_id").cast("string"), F.col("page_id").cast("string"), F.lit(None).cast("binary")
    links = F.concat(F.lit("\n[a](../"), "source", F.lit("/.//"), (F.col("doc_id") + 1).cast("string"), F.lit(".md) [b](./x/../"), id, F.lit(".md#s) [c](../../x/../pages/"), (F.col("doc_id") % 300).cast("string"), F.lit(".html) [d](http://x.y/z) [e](../) ![f](no.png) [g](../../../docs) [h](#x)"))
    texts = spread(docs(spark, sf_dir)).select(F.concat(F.lit("docs/"), "source", F.lit("/"), id, F.lit(".md")).alias("path"), F.concat("text", F.when(F.col("doc_id") % 50 == 0, " C:\\Users\\bob\\x").otherwise(""), links).alias("text"), empty.alias("content"))
    made = pages(spark, sf_dir)
    htmls = made.select(F.concat(F.lit("pages/"), page, F.lit(".html")).alias("path"), F.col("html").alias("text"), empty.alias("content"))
    number = lambda n: F.lpad(F.hex(n), 8, "0")
    header = F.unhex(F.concat(F.when(F.col("page_id") % 4 == 0, "00").otherwise("89"), F.lit("504E470D0A1A0A0000000D49484452"), number(F.col("page_id") + 800), number(F.lit(300).cast("bigint"))))
    shots = made.select(F.concat(F.lit("shots/"), page, F.lit(".png")).alias("path"), F.lit(None).cast("string").alias("text"), header.alias("content"))
    expected = made.select(F.concat(F.lit("pages/"), (F.col("page_id") * 2).cast("string"), F.lit(".html")).alias("path"))
    return audit.audit(texts.unionByName(htmls).unionByName(shots), TERMS, expected)


@query("""SELECT CAST(page_id AS VARCHAR) AS key, CASE WHEN page_id % 100 = 7 THEN 'changed' ELSE 'missing' END AS state FROM pages WHERE page_id % 100 IN (7, 8)
UNION ALL SELECT 'new ' || page_id, 'unexpected' FROM pages WHERE page_id % 100 = 9""")
def manifest_changes(spark, sf_dir):
    """The pages against a copy in which few have changed, gone or come."""
    made, old, new = pages(spark, sf_dir), sinks.shared_path(spark, "manifest"), sinks.shared_path(spark, "manifest")
    manifests.write(manifests.manifest(made, F.col("page_id"), F.col("url"), F.col("html")), old)
    kind = F.col("page_id") % 100
    copy = made.filter(kind != 8).withColumn("html", F.when(kind == 7, F.concat("html", F.lit("!"))).otherwise(F.col("html"))).withColumn("key", F.col("page_id").cast("string"))
    more = made.filter(kind == 9).withColumn("key", F.concat(F.lit("new "), F.col("page_id").cast("string")))
    manifests.write(manifests.manifest(copy.unionByName(more), F.col("key"), F.col("url"), F.col("html")), new)
    return manifests.compare(spark, old, new)
