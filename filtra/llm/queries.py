"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filtra.llm import (
    decontaminate,
    html_extract,
    license_scan,
    line_dedup,
    mixing,
    quality_classifier,
    quality_rules,
    simhash_dedup,
    span_dedup,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licences": license_scan.op1_licences,
        "op2_lines": line_dedup.op2_lines,
        "op3_spans": span_dedup.op3_spans,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality": quality_classifier.op6_quality,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_html": html_extract.op8_html,
        "op9_mixing": mixing.op9_mixing,
        "op10_simhash": simhash_dedup.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force."""
    return {"op7_quality_rules": quality_rules.SQL, "op9_mixing": mixing.SQL}
