"""The training-data pipeline: documents through the stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenespark.llm import common, decontamination, packing, secret_scan, simhash, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontamination.stage),
    ("secret_scan", secret_scan.stage),
    ("packing", packing.stage),
]
# trained models, fingerprints by another hash and a tokenizer: SQL has no form for them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each works on what the one before has kept."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
