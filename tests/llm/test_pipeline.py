"""The pipeline's stages on the smallest tables: each decision takes effect, clean documents stay."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="no test tables")
def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append(docs.count())
    assert kept[0] > kept[1] == kept[2] >= kept[3] >= kept[4] > 0.5 * kept[0]
    assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == kept[4]
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "n-gram Jaccard join"
