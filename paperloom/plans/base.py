"""What the modules of queries share: the tables, derived texts and the register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.files import table

#: Markdown made from a document: a heading, the text, a list, a table, code and a link.
RICH = ["# ", "\n\n", "\n\n- a **b**\n- [ ] ~~c~~ `d`\n\n| x | y |\n|---|:-:|\n| 1 | $z^2$ |\n\n> [l](http://e.x)\n\n```py\ncode\n```\n\nTitle\n=====\n\n---\n"]


def rich(rows: DataFrame) -> DataFrame:
    source, text = F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))
    return rows.withColumn("text", F.concat(F.lit(RICH[0]), source, F.lit(RICH[1]), text, F.lit(RICH[2])))


def sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


RICH_SQL = f"({sql(RICH[0])} || coalesce(source, '') || {sql(RICH[1])} || coalesce(text, '') || {sql(RICH[2])})"
#: Hebrew and marks around a text, so that folds and directions have something to do.
MIXED = ["ה-", " — ‏", "⁦ שלום"]


def mixed():
    return F.concat(F.lit(MIXED[0]), F.coalesce("text", F.lit("")), F.lit(MIXED[1]), F.coalesce("source", F.lit("")), F.lit(MIXED[2]))


MIXED_SQL = f"({sql(MIXED[0])} || coalesce(text, '') || {sql(MIXED[1])} || coalesce(source, '') || {sql(MIXED[2])})"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put
