import os

import corpus_pipeline
from scenespark.llm import common


def test_stages_keep_the_columns_and_only_lose_rows(spark, sf):
    docs = spark.read.parquet(os.path.join(sf, "documents.parquet"))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf), name)
        after = docs.count()
        assert docs.columns == columns and 0.8 * before <= after <= before, name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == before


def test_stages_take_odd_rows(spark, sf, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.staged(stage(spark, docs, sf), name)
