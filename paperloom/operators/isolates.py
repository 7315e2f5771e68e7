"""Pairs of isolate marks in whole texts: brackets matched by sums, without a stack.

With +1 for an opening and -1 for a closing mark, the running sum is the depth. Where it
falls below all that it was before, the closing mark has no partner, and the running minimum
counts such marks; the sum above that minimum is the depth among marks that can pair. A mark
at one depth pairs with its neighbour at the same depth, so that two windows over the marks
(not over the text) find all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.folds import emitting, let
from paperloom.kernel.values import LRI, PDI


def marks(docs: DataFrame, text: str = "text") -> DataFrame:
    """__key and a row for each mark: i, at (code points), sign; null for texts without any.
    Rows of docs that are alike give one."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    pieces, found = F.split(whole, f"[{LRI}{PDI}]", -1), F.regexp_extract_all(whole, F.lit(f"[{LRI}{PDI}]"), F.lit(0))

    def placed(c):
        item = F.transform(c["found"], lambda m, i: F.struct(F.length(F.get(c["pieces"], i)).alias("gap"), F.when(m == LRI, 1).otherwise(-1).alias("sign"), i.alias("i")))
        step = lambda at, x: F.struct((at + x["gap"] + 1).alias("state"), F.array(F.struct(x["i"].alias("i"), (at + x["gap"]).alias("at"), x["sign"].alias("sign"))).alias("out"))
        return emitting(item, F.lit(0), "int", "struct<i:int,at:int,sign:int>", step)["out"]

    rows = docs.withColumn("__key", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).withColumn("__marks", let(F.struct(pieces.alias("pieces"), found.alias("found")), placed))
    return rows.drop(text).select("*", F.inline_outer("__marks")).drop("__marks").distinct()


def isolate_balance(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of docs with pairs, nested (marks that open inside another), stray
    (closing marks without a partner), unclosed, first_fault (code points, null without a
    fault) and balanced. Null and empty texts are balanced; rows alike count once."""
    kept = [c for c in docs.columns if c not in (text, "pairs", "nested", "stray", "unclosed", "first_fault", "balanced")]
    rows = marks(docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("__text")), "__text")
    so_far = Window.partitionBy("__key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("sum", F.sum("sign").over(so_far))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("sum").over(so_far))).withColumn("low_before", F.least(F.lit(0), F.coalesce(F.min("sum").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    opens, stray = F.col("sign") == 1, (F.col("sign") == -1) & (F.col("low") < F.col("low_before"))
    level = F.when(~stray, F.col("sum") - F.col("low") + F.when(opens, 0).otherwise(1))
    rows = rows.withColumn("level", level).withColumn("partner", F.lead("at").over(Window.partitionBy("__key", "level").orderBy("i")))
    nested, unclosed = opens & (F.col("level") > 1), opens & F.col("partner").isNull()
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    found = rows.groupBy("__key").agg(*[F.first(f"__k{i}").alias(f"__k{i}") for i in range(len(kept))], count(opens & F.col("partner").isNotNull()).alias("pairs"), count(nested).alias("nested"), count(stray).alias("stray"), count(unclosed).alias("unclosed"), F.min(F.when(nested | stray | unclosed, F.col("at"))).alias("first_fault"))
    return found.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], "pairs", "nested", "stray", "unclosed", "first_fault", F.col("first_fault").isNull().alias("balanced"))
