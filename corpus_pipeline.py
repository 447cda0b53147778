"""The corpus pipeline: toxicity, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept.
``run`` writes each stage as Parquet in the shared folder and reads it back for
the next, so a lost executor costs no more than a stage's own tasks; the tables that
a stage wrote for itself, and its input, are deleted once its result is there. All but the
last stage return the columns of documents. Null and empty texts, ties, repeated
rows and empty tables are each operator's own; see their modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import mixing, neardup, packing, secretscan, toxicity
from lamina.llm.common import table
from lamina.sources.tables import discard_since, materialise, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", neardup.stage),
    ("secrets", secretscan.stage),
    ("source_mix", mixing.stage),
    ("packing", packing.stage),
]

#: Neither the learned score nor the tokenizer can be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard_since(start)
    return docs
