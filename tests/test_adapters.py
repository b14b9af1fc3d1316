"""The domain tables hold all rows of the tables they are made of."""

import os

import pytest

from claimflow.sources.adapters import domain

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/orders.parquet"), reason="no test tables")


def test_emails_have_every_line(spark):
    keys = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    emails = domain(spark, SF, "emails")
    assert {(r["order_id"], r["line"]) for r in emails.select("order_id", "line").collect()} == {tuple(r) for r in keys.collect()}
    assert emails.select("id").distinct().count() == emails.count() == keys.count()


def test_texts_hold_whole_documents(spark):
    whole = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text AS whole")
    texts = domain(spark, SF, "texts")
    assert texts.join(whole, "doc_id").where("contains(text, whole)").count() == whole.count() == texts.count()
