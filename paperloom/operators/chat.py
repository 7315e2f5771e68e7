"""Chat pages and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import dialect
from paperloom.functions.dialect import first_text
from paperloom.functions.folds import let
from paperloom.functions.text import clean_markdown

from .documents import _mapped

ACTIONS = ["insert_markdown", "replace_selection", "reply"]


def latest_response(turns: DataFrame) -> DataFrame:
    """The last answer with more than one sign of text of each conversation: conv_id, turn,
    markdown. Partial maxima come before the shuffle. Of equal turns the larger text counts."""
    answers = turns.filter((F.col("role") == "assistant") & (F.length(F.trim("text")) > 1))
    last = F.max(F.struct("turn", "text")).alias("last")
    return answers.groupBy("conv_id").agg(last).select("conv_id", F.col("last.turn").alias("turn"), F.col("last.text").alias("markdown"))


def captured(pages: DataFrame, html: str = "html", url: str = "url", provider: str = "auto", only: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """pages that may be captured, with ok, markdown, provider, label, title and error; only:
    which columns are wanted, of these, markdown_sha256 and markdown_length; keep: the columns
    of pages that are (a page that nobody reads again need not wait in Python's batches)."""
    import hashlib

    from paperloom.kernel.capture import capture

    allowed = pages.filter(dialect.can_capture(F.col(url)))

    def work(page, host):
        found = capture(page, host, provider)
        text = found["markdown"]
        return *(found[k] for k in names), None if text is None else hashlib.sha256(text.encode()).hexdigest(), None if text is None else len(text)

    names = ["ok", "markdown", "provider", "label", "title", "error"]
    schema = "ok boolean, markdown string, provider string, label string, title string, error string, markdown_sha256 string, markdown_length int"
    return _mapped(allowed, [F.coalesce(F.col(html), F.lit("")), dialect.host_of(F.col(url))], schema, work, only or names, keep)


def editor_text(codemirror: Column, textarea: Column, article: Column) -> Column:
    """The text of an editor page: the first of its three places that has any."""
    return first_text(codemirror, textarea, article)


def envelope(markdown: Column, provider: Column, title: Column) -> Column:
    """What a capture answers: ok with the cleaned text, or an error."""
    text = clean_markdown(F.coalesce(markdown, F.lit("")))
    ok = text != ""
    return F.struct(
        ok.alias("ok"), F.when(ok, text).alias("markdown"), provider.alias("provider"), dialect.provider_label(provider).alias("provider_label"),
        first_text(title, F.lit("LLM response")).alias("title"), F.when(~ok, F.lit("The captured response was empty.")).alias("error"),
    )


def parsed_action(raw: Column) -> Column:
    """action, markdown and reply of a model's answer: the JSON object in it, or the whole
    answer as a reply. Unknown actions are replies."""
    found = F.try_element_at(F.transform(F.array(F.regexp_extract(raw, r"(?s)\{.*\}", 0)), lambda x: F.nullif(x, F.lit(""))), F.lit(1))
    got = F.from_json(found, "action string, markdown string, reply string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = found.isNotNull() & got["_bad"].isNull()
    action = F.when(good & got["action"].isin(ACTIONS), got["action"]).otherwise("reply")
    reply = F.when(good, F.coalesce(got["reply"], F.lit(""))).otherwise(F.coalesce(raw, F.lit("")))
    return F.struct(action.alias("action"), F.when(good, F.coalesce(got["markdown"], F.lit(""))).otherwise("").alias("markdown"), reply.alias("reply"))


def response_text(provider: Column, body: Column) -> Column:
    """The text in the JSON answer of one of three chat services."""
    kinds = "output_text string, output array<struct<content:array<struct<type:string,text:string>>>>, content array<struct<type:string,text:string>>, candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"
    got = F.from_json(body, kinds)
    texts = lambda items: F.array_join(F.transform(F.filter(items, lambda c: c["type"] == "text"), lambda c: c["text"]), "\n")
    parts = F.array_join(F.transform(F.get(got["candidates"], F.lit(0))["content"]["parts"], lambda p: p["text"]), "")
    inner = F.array_join(F.transform(F.flatten(F.transform(got["output"], lambda o: o["content"])), lambda c: c["text"]), "\n")
    found = F.when(provider == "openai", F.coalesce(got["output_text"], inner)).when(provider == "anthropic", texts(got["content"])).otherwise(parts)
    return F.coalesce(found, F.lit(""))


def answer_of(body: Column) -> Column:
    """The text of an answer whose shape is not known beforehand, from its JSON as a VARIANT:
    the first of output_text; the texts of output[].content[]; of content (a text, or a list
    of texts and typed parts); of candidates[0].content.parts[]; of choices[0].message or
    .delta .content; message.content; response; text. Null where the body is no JSON, empty
    where it has none of these. Whatever does not have the type that a place asks for is
    passed over, so mixed shapes in one table are no error."""

    def parts(v, kinds=None):
        """The texts of a list whose members are texts or objects with a text."""
        every = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        kind = lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string"), F.lit("text"))
        own = lambda x: F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string")).when(kind(x).isin("text", "output_text"), _text(F.try_variant_get(x, "$.text", "variant")))
        return F.filter(F.transform(every, own), lambda t: t.isNotNull())

    def content(v):
        texts = parts(v)
        return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")).when(F.size(texts) > 0, F.array_join(texts, "\n"))

    def found(v):
        at = lambda path: F.try_variant_get(v, path, "variant")
        output = F.flatten(F.transform(F.coalesce(F.try_variant_get(v, "$.output", "array<variant>"), F.array().cast("array<variant>")), lambda o: parts(F.try_variant_get(o, "$.content", "variant"))))
        glued = parts(at("$.candidates[0].content.parts"))
        return F.coalesce(
            _text(at("$.output_text")), F.when(F.size(output) > 0, F.array_join(output, "\n")), content(at("$.content")), F.when(F.size(glued) > 0, F.array_join(glued, "")),
            content(at("$.choices[0].message.content")), content(at("$.choices[0].delta.content")), content(at("$.message.content")), _text(at("$.response")), _text(at("$.text")), F.lit(""),
        )

    return F.when(F.try_parse_json(body).isNotNull(), let(F.try_parse_json(body), found))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v) == kind, F.lit(False))


def _text(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def shapes(bodies: DataFrame, body: str, *keys: str) -> DataFrame:
    """keys, n and shape: one schema that all JSON bodies of a group fit, merged in partial
    aggregates; bodies that are no JSON are counted in n only."""
    return bodies.groupBy(*keys).agg(F.count("*").alias("n"), F.schema_of_variant_agg(F.try_parse_json(F.col(body))).alias("shape"))
