"""All queries over the driver's tables, with SQL where SQL can express them.

The tables hold little Markdown, so several queries first derive richer text by a
projection that both sides share (see RICH)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import dialect, features
from paperloom.functions import text as tx
from paperloom.kernel import values
from paperloom.kernel.capture import PROVIDERS
from paperloom.kernel.latex import to_mathml
from paperloom.operators import audit, chat, documents, fidelity, receipts
from paperloom.sources.files import spread
from paperloom.sources.sinks import data_url, file_name
from paperloom.streaming import stream

from . import structure  # noqa: F401  (registers its queries)
from .base import MIXED_SQL, ORACLES, QUERIES, RICH_SQL, docs as _docs, mixed as _mixed, pages as _pages, query, rich as _rich, sql as _sql, turns as _turns

#: Hosts of pages, as SQL.
_HOST = "regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"
_HINTS = ["CommonMark", " gfm ", "github", "x github.com/a", "hackmd", "hackmd.io", "llm", "mygithub", "hackmd2", "ChatGPT", "Claude 3", "deepseek", "plain", ""]
_HINT_SQL = "(SELECT unnest([" + ", ".join(_sql(h) for h in _HINTS) + "]) AS hint UNION ALL SELECT DISTINCT source FROM documents)"


def _profile_sql(column: str) -> str:
    s = f"lower(trim(coalesce({column}, '')))"
    names = " OR ".join(f"contains({s}, '{n}')" for n in dialect.CHAT_NAMES)
    return f"CASE WHEN {s} = 'commonmark' THEN 'commonmark' WHEN {s} = 'gfm' THEN 'gfm' WHEN {s} = 'github' OR contains({s}, 'github.com') THEN 'github' WHEN {s} = 'hackmd' OR contains({s}, 'hackmd.io') THEN 'hackmd' WHEN {s} = 'llm' THEN 'llm' WHEN contains({s}, 'github') THEN 'github' WHEN contains({s}, 'hackmd') THEN 'hackmd' WHEN {names} THEN 'llm' ELSE 'gfm' END"


@query(f"SELECT hint, {_profile_sql('hint')} AS profile, {_profile_sql('hint')} <> 'commonmark' AS extended FROM {_HINT_SQL}")
def profile_for_source(spark, sf_dir):
    hints = spark.createDataFrame([(h,) for h in _HINTS], "hint string").unionAll(_docs(spark, sf_dir).select(F.col("source").alias("hint")).distinct())
    p = dialect.profile_for_source(F.col("hint"))
    return hints.select("hint", p.alias("profile"), dialect.extended(p).alias("extended"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'commonmark' ELSE {_profile_sql('source')} END AS profile FROM documents")
def effective_profile(spark, sf_dir):
    chosen = F.when(F.col("doc_id") % 2 == 0, "commonmark").otherwise("auto")
    return _docs(spark, sf_dir).select("doc_id", dialect.effective_profile(chosen, F.col("source")).alias("profile"))


@query("SELECT 'paperloom' AS engine, 'auto,commonmark,gfm,github,hackmd,llm' AS profiles, 'docx,rich-html' AS outputs, 'CommonMark 0.31.2 + GFM + extensions' AS markdown")
def capabilities(spark, sf_dir):
    return spark.range(1).select(F.lit("paperloom").alias("engine"), F.lit(",".join(dialect.PROFILES)).alias("profiles"), F.lit("docx,rich-html").alias("outputs"), F.lit("CommonMark 0.31.2 + GFM + extensions").alias("markdown"))


@query(f"SELECT doc_id, sha256(regexp_replace(replace(regexp_replace({MIXED_SQL}, '([\\x{{0590}}-\\x{{05FF}}])-([A-Za-z])', '\\1־\\2', 'g'), '—', '-'), '[\\x{{200E}}\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}]', '', 'g')) AS folded_sha256 FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(tx.folded(_mixed()), 256).alias("folded_sha256"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all({MIXED_SQL}, '[\\x{{0590}}-\\x{{08FF}}]')) AS BIGINT) AS rtl, CAST(len(regexp_extract_all({MIXED_SQL}, '\\p{{L}}')) - len(regexp_extract_all({MIXED_SQL}, '[\\x{{05D0}}-\\x{{05EA}}]')) AS BIGINT) AS ltr, regexp_matches({MIXED_SQL}, '[\\x{{0590}}-\\x{{08FF}}]') AS has_rtl FROM documents")
def direction_stats(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.rtl_count(_mixed()).alias("rtl"), tx.ltr_count(_mixed()).alias("ltr"), tx.contains_rtl(_mixed()).alias("has_rtl"))


_LINES = f"string_split_regex({RICH_SQL}, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]')"


@query(f"""WITH d AS (SELECT doc_id, {RICH_SQL} AS t, {_LINES} AS l FROM documents)
SELECT doc_id, CAST(octet_length(encode(t)) AS BIGINT) AS bytes, CAST(len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS lines, sha256(t) AS sha256, contains(t, '—') AS em_dash, regexp_matches(t, '[A-Za-z]') AS ltr,
  CAST(len(list_filter(l, lambda x: regexp_matches(x, '^\\s*(```|~~~)'))) // 2 AS BIGINT) AS fences, CAST(len(list_filter(l, lambda x: regexp_matches(x, '^\\s*>'))) AS BIGINT) AS quotes
FROM d""")
def preflight_features(spark, sf_dir):
    found = features.preflight(_rich(_docs(spark, sf_dir)))
    return found.select("doc_id", F.col("f_bytes").alias("bytes"), F.col("f_lines").alias("lines"), "sha256", F.col("f_contains_em_dash").alias("em_dash"), F.col("f_contains_ltr").alias("ltr"), F.col("f_fenced_code_blocks").alias("fences"), F.col("f_blockquotes").alias("quotes"))


@query()
def preflight_all_features(spark, sf_dir):
    found = features.preflight(_rich(spread(_docs(spark, sf_dir))))
    return found.select("doc_id", "valid", "errors", "sha256", *[c for c in found.columns if c.startswith("f_")])


@query("SELECT lang, count(*) AS docs, CAST(count(*) FILTER (regexp_matches(coalesce(text, ''), '\\S')) AS BIGINT) AS not_empty, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def preflight_summary_by_lang(spark, sf_dir):
    found = features.preflight(spread(_docs(spark, sf_dir)))
    not_empty = F.sum((~F.exists("errors", lambda e: e == "Markdown input is empty")).cast("bigint"))
    return found.groupBy("lang").agg(F.count("*").alias("docs"), not_empty.alias("not_empty"), F.sum("f_bytes").alias("bytes"))


_LATEST = "SELECT conv_id, turn, text AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS n FROM conversations WHERE role = 'assistant' AND length(trim(text)) > 1) WHERE n = 1"


@query(_LATEST)
def latest_assistant_response(spark, sf_dir):
    return chat.latest_response(_turns(spark, sf_dir))


@query(_LATEST)
def answers_streamed(spark, sf_dir):
    """The same by keyed state over a stream of the turns."""
    return stream.answers_streamed(spark, f"{sf_dir}/conversations.parquet")


_RAW = "' a' || chr(13) || chr(10) || text || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || '  b '"


@query(f"SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({_RAW}, chr(13), ''), '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^[ \\t]+|[ \\t]+$', '', 'g'), chr(10) || ' ' || chr(9))) AS cleaned_sha256 FROM conversations")
def clean_markdown(spark, sf_dir):
    raw = F.concat(F.lit(" a\r\n"), "text", F.lit("  \n\n\n\n  b "))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.sha2(tx.clean_markdown(raw), 256).alias("cleaned_sha256"))


@query(r"""SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(replace('- \_#' || text, '\', '\\'), '([`*_\[\]{}<>#$~^+=!])', '\\\1', 'g'), '(^|\n)([ \t]*)([-+>])', '\1\2\\\3', 'g')) AS escaped_sha256 FROM conversations""")
def escape_markdown(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.sha2(tx.escape_markdown(F.concat(F.lit("- \\_#"), "text")), 256).alias("escaped_sha256"))


_TOKENS = "regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


@query(f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY doc_id, token")
def token_counts(spark, sf_dir):
    return fidelity.token_counts(spread(_docs(spark, sf_dir)), "doc_id", "text")


@query(f"""WITH p AS (SELECT conv_id, turn, text AS e, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
e AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest({_TOKENS.format("coalesce(e, '')")}) AS t FROM p) GROUP BY ALL),
a AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest({_TOKENS.format("coalesce(a, '')")}) AS t FROM p) GROUP BY ALL),
s AS (SELECT e.conv_id, e.turn, sum(e.n) AS x, sum(greatest(0, e.n - coalesce(a.n, 0))) AS m FROM e LEFT JOIN a ON e.conv_id = a.conv_id AND e.turn = a.turn AND e.t = a.t GROUP BY ALL)
SELECT p.conv_id, p.turn, CAST(coalesce(x, 0) AS BIGINT) AS expected_tokens, CAST(coalesce(m, 0) AS BIGINT) AS missing_tokens, coalesce((x - m) / CAST(x AS DOUBLE), 1.0) AS token_coverage FROM p LEFT JOIN s ON p.conv_id = s.conv_id AND p.turn = s.turn""")
def token_fidelity(spark, sf_dir):
    from pyspark.sql import Window

    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = _turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("k"), F.col("text").alias("e"), following.alias("a"))
    return fidelity.fidelity(pairs, "k", "e", "a").select("k.conv_id", "k.turn", "expected_tokens", "missing_tokens", "token_coverage")


_PROVIDER = "CASE " + " ".join(f"WHEN regexp_matches(h, '{'|'.join(v[1])}') THEN '{k}'" for k, v in PROVIDERS.items() if v[1]) + " ELSE 'generic' END"


@query(f"SELECT page_id, h AS host, {_PROVIDER} AS provider, {_PROVIDER.replace('(h,', chr(40) + chr(39) + 'chat.' + chr(39) + ' || h,')} AS other FROM (SELECT page_id, {_HOST} AS h FROM pages WHERE NOT regexp_matches(lower(coalesce(url, '')), '^(chrome|edge|about|view-source):'))")
def capture_filterable_pages(spark, sf_dir):
    host = dialect.host_of(F.col("url"))
    return _pages(spark, sf_dir).filter(dialect.can_capture(F.col("url"))).select("page_id", host.alias("host"), dialect.provider(host).alias("provider"), dialect.provider(F.concat(F.lit("chat."), host)).alias("other"))


_URLS = ["https://chatgpt.com/c/1", "https://www.claude.ai/x", "http://chat.deepseek.com:80/", "https://evilgrok.com", "https://x.com/a", "chrome://x", "https://m365.cloud.microsoft/chat"]


@query(f"SELECT page_id, h AS host, {_PROVIDER} AS provider, NOT regexp_matches(lower(u), '^(chrome|edge|about|view-source):') AS allowed FROM (SELECT page_id, u, {_HOST.replace('url', 'u')} AS h FROM (SELECT page_id, [{', '.join(map(_sql, _URLS))}][page_id % {len(_URLS)} + 1] || '/?' || coalesce(url, '') AS u FROM pages))")
def detect_provider(spark, sf_dir):
    """The pages as if each chat site in turn had linked to them."""
    url = F.concat(F.get(F.array(*map(F.lit, _URLS)), (F.col("page_id") % len(_URLS)).cast("int")), F.lit("/?"), F.coalesce("url", F.lit("")))
    host = dialect.host_of(url)
    return _pages(spark, sf_dir).select("page_id", host.alias("host"), dialect.provider(host).alias("provider"), dialect.can_capture(url).alias("allowed"))


@query()
def html_capture(spark, sf_dir):
    wanted = ["ok", "provider", "title", "error", "markdown_sha256", "markdown_length"]
    return chat.captured(spread(_pages(spark, sf_dir)), only=wanted, keep=["page_id"]).select("page_id", *wanted[:-1], F.col("markdown_length").alias("length"))


@query()
def md_nodes(spark, sf_dir):
    return documents.nodes(_rich(spread(_docs(spark, sf_dir))).select("doc_id", "text"), only=["node_id", "parent_id", "place", "depth", "kind", "literal"])


@query()
def md_node_summary(spark, sf_dir):
    """Nodes by language and kind. Documents that no tree can be made of have rows of their
    own, without a kind: how many failed, and one of the reasons."""
    found = documents.nodes(_rich(spread(_docs(spark, sf_dir))).select("lang", "text"), only=["depth", "kind"])
    return found.groupBy("lang", "kind").agg(F.count("kind").alias("n"), F.max("depth").alias("deepest"), F.count("kernel_error").alias("failed"), F.min("kernel_error").alias("kernel_error"))


_COMMANDS = [*values.SYMBOLS]


@query(f"""WITH w AS (SELECT unnest(list_append(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), [{", ".join(map(_sql, _COMMANDS))}][doc_id % {len(_COMMANDS)} + 1])) AS command FROM documents)
SELECT w.command, count(*) AS n, any_value(s.sign) AS sign FROM w LEFT JOIN (VALUES {", ".join(f"({_sql(k)}, {_sql(v)})" for k, v in values.SYMBOLS.items())}) AS s(command, sign) ON w.command = s.command GROUP BY w.command""")
def math_symbols(spark, sf_dir):
    """The words of all texts, and a command for each text, looked up as commands."""
    given = F.get(F.array(*map(F.lit, _COMMANDS)), (F.col("doc_id") % len(_COMMANDS)).cast("int"))
    words = F.array_append(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), given)
    found = spread(_docs(spark, sf_dir)).select(F.explode(words).alias("command")).groupBy("command").agg(F.count("*").alias("n"))
    return found.select("command", "n", tx.math_symbol(F.col("command")).alias("sign"))


def _run_sql(text: str) -> str:
    return f"regexp_replace({text}, '(.)', '<m:r><m:t>\\1</m:t></m:r>', 'g')"


@query(f"""SELECT doc_id, CAST(length(source) + 13 AS INT) AS tokens, sha256('<m:oMath><m:f><m:num><m:sSub><m:e>' || {_run_sql("'α'")} || '</m:e><m:sub>' || {_run_sql("'1'")} || '</m:sub></m:sSub></m:num><m:den>' || {_run_sql("source")} || '</m:den></m:f><m:r><m:t>+</m:t></m:r><m:rad><m:radPr><m:degHide m:val="1"/></m:radPr><m:deg/><m:e>' || {_run_sql("'x'")} || '</m:e></m:rad></m:oMath>') AS omml_sha256,
  sha256('{to_mathml("").split("<mrow>")[0].replace("'", "''")}<mrow><mfrac><mrow><msub><mrow><mi>α</mi></mrow><mrow><mn>1</mn></mrow></msub></mrow><mrow>' || regexp_replace(regexp_replace(source, '([a-z])', '<mi>\\1</mi>', 'g'), '([0-9])', '<mn>\\1</mn>', 'g') || '</mrow></mfrac><mo>+</mo><msqrt><mrow><mi>x</mi></mrow></msqrt></mrow></math>') AS mathml_sha256 FROM documents""")
def math_formulas(spark, sf_dir):
    rows = spread(_docs(spark, sf_dir)).select("doc_id", F.concat(F.lit("\\frac{\\alpha_1}{"), "source", F.lit("}+\\sqrt{x}")).alias("latex"))
    return documents.formulas(rows, "latex").select("doc_id", F.size("tokens").alias("tokens"), F.sha2("omml", 256).alias("omml_sha256"), F.sha2("mathml", 256).alias("mathml_sha256"))


@query()
def compile_docx_hash(spark, sf_dir):
    return documents.compiled(_rich(spread(_docs(spark, sf_dir))).select("doc_id", "text"), only=["docx_sha256", "docx_bytes"]).select("doc_id", "docx_sha256", F.col("docx_bytes").alias("bytes"))


@query()
def validate_docx(spark, sf_dir):
    texts = _rich(spread(_docs(spark, sf_dir))).select("doc_id", "text")
    return documents.package_report(texts, text="text").select("doc_id", "package.valid", "package.checks", "semantics.stats", F.col("semantics.valid").alias("semantics_valid"))


@query(f"SELECT doc_id, {_sql(','.join(values.PARTS))} AS names, CAST(0 AS INT) AS missing, CAST(0 AS INT) AS unexpected, CAST(NULL AS VARCHAR) AS kernel_error FROM documents")
def read_packages(spark, sf_dir):
    texts = spread(_docs(spark, sf_dir)).select("doc_id", "text")
    required = F.array(*map(F.lit, values.PARTS))
    check = receipts.set_check(required, F.col("names"))
    return documents.parts(texts, text="text").select("doc_id", F.array_join("names", ",").alias("names"), F.size(check["missing"]).alias("missing"), F.size(check["unexpected"]).alias("unexpected"), "kernel_error")


#: Markdown with every construct once or more around two short columns, and what its tree
#: and its package hold: counted by hand from the grammar, as SQL has no parser.
FIXED = [
    "# ", " *e* **s** ~~d~~ ==h== `c`\n\n", "\n=====\n\n> [!NOTE]\n> in **it**\n\n> q\n> > qq\n\n- a\n- [x] t\n  1. n\n\n1. o\n2. p\n\n| x | y |\n|---|:-:|\n| $z^2$ | ![i](u) |\n\n```py\ncode\n```\n\n    ind\n\n---\n\n"
    "[l](http://e.x) [[w]] <b>\\\nnext[^f]\n\n[^f]: note\n\nterm\n: details\n\n-# small\n\n:::box\nin\n:::\n\n<div>\nraw\n</div>\n\n$$x$$\n",
]
FIXED_NODES = {
    "document": 1, "heading": 2, "paragraph": 13, "emph": 1, "strong": 2, "strike": 1, "highlight": 1, "code": 1, "alert": 1, "quote": 2, "list": 3, "item": 4, "task_item": 1, "table": 1, "table_row": 2, "table_cell": 4, "math": 2, "image": 1,
    "code_block": 2, "rule": 1, "link": 1, "wikilink": 1, "html_inline": 1, "line_break": 1, "footnote_ref": 1, "footnote": 1, "description_list": 1, "description_item": 1, "description_term": 1, "description_details": 1, "subtext": 1, "directive": 1, "html_block": 1,
}
FIXED_MARKS = {"headings": 2, "tables": 1, "list_items": 5, "math_expressions": 2, "rtl_tables": 0, "bold_runs": 7, "strike_runs": 1}


def _fixed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(F.lit(FIXED[0]), F.coalesce("source", F.lit("x")), F.lit(FIXED[1]), F.coalesce("lang", F.lit("x")), F.lit(FIXED[2])).alias("text"))


@query("SELECT doc_id, kind, CAST(n AS BIGINT) AS n FROM documents CROSS JOIN (VALUES " + ", ".join(f"('{k}', {n})" for k, n in FIXED_NODES.items()) + ") AS t(kind, n)")
def md_fixed_nodes(spark, sf_dir):
    """Nodes of each document by kind. The columns have no place for a failure, so one that
    no tree can be made of ends the query with its reason."""
    found = documents.nodes(_fixed(spread(_docs(spark, sf_dir))), only=["kind"])
    failed = F.raise_error(F.concat(F.lit("no tree of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(": "), F.col("kernel_error"))).cast("string")
    kind = F.when(F.col("kernel_error").isNotNull(), failed).otherwise(F.col("kind"))
    return found.select("doc_id", kind.alias("kind")).filter("kind not in ('text', 'soft_break')").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, true AS package_valid, " + ", ".join(f"CAST({n} AS BIGINT) AS {k}" for k, n in FIXED_MARKS.items()) + " FROM documents")
def docx_fixed_marks(spark, sf_dir):
    made = documents.built(_fixed(spread(_docs(spark, sf_dir))), only=["package", "coverage"])
    return made.select("doc_id", F.col("package.valid").alias("package_valid"), *[F.col(f"coverage.actual.{k}").alias(k) for k in FIXED_MARKS])


@query(f"""WITH d AS (SELECT doc_id, {RICH_SQL} AS t FROM documents)
SELECT doc_id, sha256(t) AS input_sha256, CAST(octet_length(encode(t)) AS BIGINT) AS input_bytes, doc_id % 2 = 0 AS input_sha256_verified, true AS markdown_preflight, true AS core_self_test, true AS engine_verified, doc_id % 3 <> 0 AS deterministic_replay, CAST(NULL AS VARCHAR) AS kernel_error FROM d""")
def verify_run(spark, sf_dir):
    """Packages of the texts, of which every third is that of another text, against the
    hash that the text should have, which is wrong for every second."""
    docs = _rich(spread(_docs(spark, sf_dir))).select("doc_id", "text")
    other = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n\nmore\n"))).otherwise(F.col("text"))
    expected = F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2("text", 256))).otherwise(F.lit("0" * 64))
    gates = ["input_sha256_verified", "markdown_preflight", "core_self_test", "engine_verified", "deterministic_replay"]
    found = documents.verified(docs.withColumn("other", other), of="other", expected=expected, only=["input_sha256", "input_bytes", "checks"], keep=["doc_id"])
    return found.select("doc_id", "input_sha256", "input_bytes", *[F.col(f"checks.{g}").alias(g) for g in gates], "kernel_error")


@query(f"SELECT true AS valid, true AS deterministic, {_sql(values.CREATOR)} AS engine, CAST(0 AS INT) AS errors, true AS same")
def self_test(spark, sf_dir):
    found = documents.doctor(spark)
    return found.select("valid", "deterministic", "engine", F.size("errors").alias("errors"), (F.col("first_sha256") == F.col("second_sha256")).alias("same"))


_PAGE = ['<title>T</title><div class="prose">old</div><div class="prose"><h2>A*</h2><p>Hi <b>', '</b> <a href="http://x/a b">l</a></p><ol><li>one<ul><li>in</ul><li>two</ol><table><tr><th>h<tr><td>x|y<td>', "</table><button>no</button></div>"]


@query(r"SELECT page_id, true AS ok, 'T' AS title, '## A\*' || chr(10) || chr(10) || 'Hi **' || page_id || '** [l](<http://x/a%20b>)' || chr(10) || chr(10) || '1. one' || chr(10) || chr(10) || '- in' || chr(10) || '2. two' || chr(10) || chr(10) || '| h |  |' || chr(10) || '| --- | --- |' || chr(10) || '| x\|y | ' || page_id || ' |' AS markdown FROM pages")
def html_capture_fixed(spark, sf_dir):
    page = F.col("page_id").cast("string")
    rows = spread(_pages(spark, sf_dir)).select("page_id", F.lit("https://a.b/c").alias("url"), F.concat(F.lit(_PAGE[0]), page, F.lit(_PAGE[1]), page, F.lit(_PAGE[2])).alias("html"))
    return chat.captured(rows, provider="generic").select("page_id", "ok", "title", "markdown")


@query()
def build_report(spark, sf_dir):
    wanted = ["valid", "errors", "input_sha256", "output_sha256", "replay", "fidelity", "coverage"]
    found = documents.built(_rich(spread(_docs(spark, sf_dir))).select("doc_id", "text"), only=wanted)
    return found.select("doc_id", "valid", "errors", "input_sha256", "output_sha256", "replay", "fidelity.token_coverage", F.col("coverage.valid").alias("coverage_valid"))


@query()
def build_summary(spark, sf_dir):
    found = documents.built(spread(_docs(spark, sf_dir)).select("lang", "text"), only=["valid", "replay"])
    return found.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.col("valid").cast("bigint")).alias("valid"), F.sum(F.col("replay").cast("bigint")).alias("replayed"))


@query()
def rich_html(spark, sf_dir):
    found = documents.rich(_rich(spread(_docs(spark, sf_dir))), only=["html_sha256", "html_length"], keep=["doc_id"])
    return found.select("doc_id", "html_sha256", F.col("html_length").alias("length"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 90 THEN left(text, 90) || '…' ELSE text END AS preview, coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_-]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'llm') || '.docx' AS file FROM conversations")
def previews_and_names(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", tx.preview(F.col("text")).alias("preview"), file_name(F.col("text")).alias("file"))


@query("SELECT doc_id, 'data:application/vnd.openxmlformats-officedocument.wordprocessingml.document;base64,' || to_base64(encode(text)) AS url FROM documents")
def download_links(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", data_url(F.col("text").cast("binary")).alias("url"))


@query("SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE NULL END, ''), nullif(CASE WHEN page_id % 2 = 0 THEN url ELSE '' END, ''), html) AS text, regexp_matches(lower(url || '/a.MD'), '\\.(md|txt|markdown)$') AS is_markdown, 'a' AS name FROM pages")
def editor_pages(spark, sf_dir):
    page = F.col("page_id")
    text = chat.editor_text(F.when(page % 3 == 0, ""), F.when(page % 2 == 0, F.col("url")).otherwise(""), F.col("html"))
    path = F.concat("url", F.lit("/a.MD"))
    return _pages(spark, sf_dir).select("page_id", text.alias("text"), dialect.is_markdown_path(path).alias("is_markdown"), dialect.document_name(path).alias("name"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'insert_markdown' ELSE 'reply' END AS action, CASE WHEN turn % 3 = 2 THEN '' ELSE coalesce(text, '') END AS markdown, CASE WHEN turn % 3 = 2 THEN coalesce(text, '') ELSE '' END AS reply FROM conversations")
def chat_actions(spark, sf_dir):
    text, turn = F.coalesce("text", F.lit("")), F.col("turn") % 3
    said = lambda action: F.to_json(F.struct(F.lit(action).alias("action"), text.alias("markdown")))
    raw = F.when(turn == 0, F.concat(F.lit("Sure: "), said("insert_markdown"))).when(turn == 1, said("delete")).otherwise(text)
    return _turns(spark, sf_dir).select("conv_id", "turn", chat.parsed_action(raw).alias("a")).select("conv_id", "turn", "a.*")


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' ELSE 'gemini' END AS source, coalesce(text, '') AS text FROM conversations")
def provider_answers(spark, sf_dir):
    turn, role = F.col("turn") % 3, F.coalesce("text", F.lit(""))
    name = F.when(turn == 0, "openai").when(turn == 1, "anthropic").otherwise("gemini")
    body = F.when(turn == 0, F.to_json(F.struct(role.alias("output_text")))).when(turn == 1, F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), role.alias("text"))).alias("content")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(role.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))))
    return _turns(spark, sf_dir).select("conv_id", "turn", dialect.addin_source(name).alias("source"), chat.response_text(name, body).alias("text"))


@query("SELECT doc_id, n <> 3 AND n > 0 AS visual_valid FROM (SELECT doc_id, doc_id % 4 AS n FROM documents)")
def visual_gate(spark, sf_dir):
    n = (F.col("doc_id") % 4).cast("int")
    pages = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    rows = _docs(spark, sf_dir).select("doc_id", n.alias("pages_expected"), n.alias("pages_rendered"), n.alias("pages_reviewed"), pages.alias("reviewed_pages"), F.when(n == 3, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("issues"), n.alias("images"), *[F.lit("h").alias(c) for c in ("docx_sha256", "pdf_sha256", "actual_docx_sha256", "actual_pdf_sha256")])
    return receipts.visual_gate(rows).select("doc_id", "visual_valid")


@query("""SELECT CAST(page_id AS VARCHAR) AS name, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'changed' ELSE 'same' END AS state FROM pages
UNION ALL SELECT 'new ' || page_id, 'unexpected' FROM pages WHERE page_id % 11 = 0""")
def golden_images(spark, sf_dir):
    """The pages as pictures, against a set in which some are gone, changed or new."""
    html = F.coalesce("html", F.lit(""))
    shots = lambda rows, name, bytes_: rows.select(name.alias("name"), F.octet_length(bytes_).alias("bytes"), F.sha2(bytes_, 256).alias("sha256"))
    made, name = _pages(spark, sf_dir), F.col("page_id").cast("string")
    kept = shots(made.filter("page_id % 5 <> 0"), name, F.concat(html, F.when(F.col("page_id") % 7 == 0, "!").otherwise("")))
    new = shots(made.filter("page_id % 11 = 0"), F.concat(F.lit("new "), name), html)
    return receipts.golden_diff(shots(made, name, html), kept.unionByName(new))


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 = 0 AS valid FROM documents")
def runtime_manifests(spark, sf_dir):
    value = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("schema_version"), F.when(F.col("doc_id") % 3 == 0, "paperloom").otherwise("x").alias("engine"), F.create_map(F.lit("bin"), F.col("source")).alias("binaries")))
    return receipts.runtime_manifest(_docs(spark, sf_dir).select("doc_id", value.alias("value"))).select("doc_id", "valid")


@query("SELECT 'd/' || doc_id || '.md' AS path, (doc_id + 1) || '.md' AS target FROM documents WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents)")
def repository_links(spark, sf_dir):
    link = F.concat(F.coalesce("text", F.lit("")), F.lit("\nsee [x]("), (F.col("doc_id") + 1).cast("string"), F.lit(".md) and [y](http://a.b)"))
    return audit.broken_links(_docs(spark, sf_dir).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), link.alias("text")))


@query("SELECT turn, '| ' || turn || ' | b |' || chr(10) || '| --- | --- |' || chr(10) || '| x\\|y |  |' AS markdown FROM conversations GROUP BY turn")
def ragged_tables(spark, sf_dir):
    rows = F.array(F.array(F.col("turn").cast("string"), F.lit("b")), F.array(F.lit("x|y")))
    return _turns(spark, sf_dir).select("turn").distinct().select("turn", tx.table_markdown(rows).alias("markdown"))


@query("SELECT doc_id, (n_chars // 2) || CASE WHEN n_chars % 2 = 1 THEN '.5' ELSE '' END AS size FROM documents")
def theme_points(spark, sf_dir):
    """The lengths of the texts as half points."""
    return _docs(spark, sf_dir).select("doc_id", tx.points(F.col("n_chars"), 2).alias("size"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preflight of all documents, summed by language."""
    return preflight_summary_by_lang(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
