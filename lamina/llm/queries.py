"""The queries of this package's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, htmltext, langid, mixing, neardup, packing, pii, secretscan, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": topk.query,
        "op2_html_text": htmltext.query,
        "op3_toxicity": toxicity.query,
        "op4_language": langid.query,
        "op5_fingerprints": fingerprints.query,
        "near_by_edits": fingerprints.near_query,
        "op6_secrets": secretscan.query,
        "op7_near_duplicates": neardup.query,
        "op8_personal_data": pii.query,
        "op9_source_mix": mixing.query,
        "op10_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": topk.ORACLE, "op9_source_mix": mixing.ORACLE}
