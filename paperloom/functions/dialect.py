"""Which Markdown dialect a source writes, and which chat provider a page belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.kernel.capture import PROVIDERS

PROFILES = ["auto", "commonmark", "gfm", "github", "hackmd", "llm"]
#: Names in a source that mean a chat model.
CHAT_NAMES = ["chatgpt", "openai", "claude", "gemini", "copilot", "grok", "perplexity", "deepseek", "llm"]


def profile_for_source(source: Column) -> Column:
    """The dialect of a source hint; the first rule that holds decides."""
    s = F.lower(F.regexp_replace(F.coalesce(source, F.lit("")), r"(?U)^\s+|\s+$", ""))
    any_of = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: s.contains(n))
    return (
        F.when(s == "commonmark", "commonmark").when(s == "gfm", "gfm").when((s == "github") | s.contains("github.com"), "github").when((s == "hackmd") | s.contains("hackmd.io"), "hackmd")
        .when(s == "llm", "llm").when(s.contains("github"), "github").when(s.contains("hackmd"), "hackmd").when(any_of(CHAT_NAMES), "llm").otherwise("gfm")
    )


def effective_profile(profile: Column, source: Column) -> Column:
    return F.when(F.coalesce(profile, F.lit("auto")) == "auto", profile_for_source(source)).otherwise(profile)


def extended(profile: Column) -> Column:
    """Whether the extensions are on: in every dialect but commonmark."""
    return profile != "commonmark"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def provider(host: Column) -> Column:
    chosen = F.lit("generic")
    for name, (_, hosts, _) in reversed(list(PROVIDERS.items())):
        if hosts:
            chosen = F.when(host.rlike("|".join(hosts)), name).otherwise(chosen)
    return chosen


def provider_label(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in PROVIDERS.items() for x in (k, v[0])])
    return F.coalesce(F.try_element_at(table, name), F.lit("LLM"))


def addin_source(name: Column) -> Column:
    """The source hint of a chat service that an editor add-in talks to."""
    return F.when(name == "openai", "chatgpt").when(name == "anthropic", "claude").when(name == "gemini", "gemini").otherwise("llm")


def can_capture(url: Column) -> Column:
    """Browser-internal pages cannot be captured."""
    return ~F.lower(F.coalesce(url, F.lit(""))).rlike("^(chrome|edge|about|view-source):")


def is_markdown_path(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|txt|markdown)$")


def document_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?i)\.(md|txt|markdown)$", "")


def first_text(*texts: Column) -> Column:
    """The first of several texts that is there and not empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])
