"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contamination, counts, hmm, merkle, mixing, nearest, neardup, pieces, pii, quality, resampling, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hmm": hmm.op1_hmm,
        "op2_pii": pii.op2_pii,
        "op3_pieces": pieces.op3_pieces,
        "op4_counts": counts.op4_counts,
        "op5_neardup": neardup.op5_neardup,
        "op6_decontamination": contamination.op6_decontamination,
        "op7_quality": quality.op7_quality,
        "op8_warc": warc.op8_warc,
        "op9_topk": nearest.op9_topk,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_merkle": merkle.op11_merkle,
        "op12_mixing": mixing.op12_mixing,
        "op13_resampling": resampling.op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    """Only for queries that SQL can express on whole tables."""
    return {
        "op2_pii": pii.ORACLE_SQL,
        "op6_decontamination": contamination.ORACLE_SQL,
        "op8_warc": warc.ORACLE_SQL,
        "op9_topk": nearest.ORACLE_SQL,
        "op11_merkle": merkle.ORACLE_SQL,
        "op12_mixing": mixing.ORACLE_SQL,
        "op13_resampling": resampling.ORACLE_SQL,
    }
