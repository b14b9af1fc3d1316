"""Queries over texts and amounts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimflow.functions.amounts import first_amount, parse_amount
from claimflow.operators import extraction as ex
from claimflow.sources.adapters import domain, inlined


def t1_clean_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("html").alias("raw_body_html"), F.lit(None).cast("string").alias("raw_body_text"))
    return ex.clean_bodies(pages).select("page_id", "tokens_before", "tokens_after", F.md5("cleaned_body").alias("digest"))


def t2_clean_conversations(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    text = F.concat("text", F.lit("\n> quoted\n"), F.when(F.col("turn") % 2 == 0, "On 2024-01-01, A wrote:\nold text").otherwise(""))
    return ex.clean_bodies(c.select("conv_id", "turn", text.alias("raw_body_text"), F.lit(None).cast("string").alias("raw_body_html"))).select("conv_id", "turn", "cleaned_body", "tokens_before", "tokens_after")


def t3_signature(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    text = F.concat(F.lit("Gruss\n"), F.when(F.col("s_suppkey") % 2 == 0, "Muster Inkasso GmbH").otherwise("ohne"), F.lit("\nTel: +49 761 "), F.col("s_suppkey").cast("string"))
    return s.select("s_suppkey", ex.signature_info(text).alias("i")).select("s_suppkey", F.col("i.company").isNotNull().alias("has_company"), "i.phone")


def t4_token_savings(spark, sf):
    return ex.token_savings(t2_clean_conversations(spark, sf))


def t5_amount_candidates(spark, sf):
    found = ex.amount_candidates(domain(spark, sf, "texts"))
    return found.groupBy("tier", "confidence").agg(F.count("*").alias("hits"), F.round(F.sum("value"), 2).alias("total"))


def t6_best_amount(spark, sf):
    return ex.best_amount(ex.amount_candidates(domain(spark, sf, "texts")))


def t7_parse_amount(spark, sf):
    i = domain(spark, sf, "inquiries")
    whole, cents = F.floor("debt_amount").cast("long"), F.lpad(((F.col("id") % 100).cast("int")).cast("string"), 2, "0")
    thousands, rest = F.floor(whole / 1000), F.lpad((whole % 1000).cast("string"), 3, "0")
    text = F.when(F.col("id") % 3 == 0, F.concat(thousands.cast("string"), F.lit("."), rest, F.lit(","), cents, F.lit(" EUR")))
    text = text.when(F.col("id") % 3 == 1, F.concat(F.lit("€ "), thousands.cast("string"), F.lit(","), rest, F.lit("."), cents)).otherwise(F.concat(thousands.cast("string"), F.lit("."), rest))
    return i.select("id", parse_amount(text).alias("value"), first_amount(F.concat(F.lit("total "), text, F.lit(" and 3,00"))).alias("first"))


def t9_names(spark, sf):
    t = domain(spark, sf, "texts")
    return t.select("doc_id", ex.extract_names(F.col("text")).alias("n")).select("doc_id", "n.client", "n.client_confidence").where("client IS NOT NULL")


def t10_normalize(spark, sf):
    t = domain(spark, sf, "texts").withColumn("text", F.concat(F.lit("Gruesse  und schoene\nTage "), F.col("text")))
    words = spark.createDataFrame([("grüsse",), ("schöne",)], "word string")
    return ex.normalize_german(t, words).select("doc_id", F.substring("text", 1, 22).alias("head"), F.sha2("text", 256).alias("whole"))


def t11_validate(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    number = F.col("c_custkey").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(5), F.length(number)), "0")  # lpad alone cuts longer numbers
    code = F.when(F.col("c_custkey") % 3 == 0, padded).otherwise(number)
    street = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Am Ring "), F.col("c_custkey").cast("string"), F.lit("a"))).otherwise(F.lit("Am Ring"))
    return c.select("c_custkey", ex.validate_german("postal_code", code).alias("code_ok"), ex.validate_german("name", F.col("c_name")).alias("name_ok"), ex.validate_german("address", street).alias("street_ok"))


def t12_cells(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("price"))
    num = F.when(F.col("l_linenumber") % 2 == 0, F.col("price"))
    text = F.when(F.col("l_linenumber") % 2 == 1, F.when(F.col("l_orderkey") % 2 == 0, "Gesamtforderung").otherwise("Notiz")).otherwise(F.lit(None))
    return ex.cell_amounts(li.select(F.col("l_orderkey").cast("string").alias("file"), F.lit("s").alias("sheet"), F.lit(1).alias("row"), F.col("l_linenumber").alias("col"), text.alias("value_text"), num.alias("value_num")))


def t13_attachments(spark, sf):
    s = domain(spark, sf, "sources")
    name = F.concat(F.lit("f."), F.when(F.col("source_type") == "pdf", "PDF").when(F.col("source_type") == "image", "png").otherwise(F.col("source_type")))
    a = s.select("email_id", F.col("source_idx").alias("idx"), name.alias("filename"), F.lit(None).cast("string").alias("content_type"), F.lit(1000).alias("file_size"), (F.col("tokens_used") % 20).alias("sampled_text_len"), F.lit(False).alias("encrypted"), (F.col("tokens_used") * 60).alias("tokens_used"))
    return ex.attachment_plan(a).select("email_id", "idx", "format", "scanned", "processed", "rank")


def t15_model_json(spark, sf):
    m = domain(spark, sf, "emails")
    answer = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct("intent", "confidence")), F.lit("\n```"))
    parsed = ex.parse_model_json(F.when(F.col("part") % 4 == 0, "no json").otherwise(answer), "intent string, confidence double")
    total = ex.component_total(F.when(F.col("part") % 2 == 0, F.col("debt_amount")), F.create_map(F.lit("a"), F.col("debt_amount"), F.lit("b"), F.lit(5.0)))
    return m.select("id", F.coalesce(parsed["intent"], F.lit("no_clear_response")).alias("intent"), F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"), F.round(total["value"], 2).alias("total"), total["confidence"].alias("total_confidence"))


def t17_case_refs(spark, sf):
    t = domain(spark, sf, "texts")
    return t.select("doc_id", F.array_join(ex.case_refs(F.col("text")), ",").alias("refs"), ex.letter_type(F.col("text")).alias("letter"))


def t19_entity_guard(spark, sf):
    m = domain(spark, sf, "emails").withColumns({"body": F.when(F.col("part") % 5 == 0, "kurz").otherwise(F.col("body")), "attachment_text": F.when(F.col("part") % 10 == 0, "text"), "is_creditor_reply": F.lit(True), "debt_amount": F.col("debt_amount") * 10})
    return ex.entity_guard(m).select("id", "is_creditor_reply", "confidence", F.round("debt_amount", 2).alias("debt_amount"))


QUERIES = {f.__name__: f for f in (t1_clean_pages, t2_clean_conversations, t3_signature, t4_token_savings, t5_amount_candidates, t6_best_amount, t7_parse_amount, t9_names, t10_normalize, t11_validate, t12_cells, t13_attachments, t15_model_json, t17_case_refs, t19_entity_guard)}

_CONV = """WITH c AS (SELECT conv_id, turn, text || chr(10) || '> quoted' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'On 2024-01-01, A wrote:' || chr(10) || 'old text' ELSE '' END AS raw, text FROM conversations),
 q AS (SELECT *, CASE WHEN length(raw) < 200 THEN raw WHEN length(text) + 1 < 200 AND length(text) + 1 < length(raw) * 0.2 THEN raw ELSE text || chr(10) END AS cut FROM c),
 d AS (SELECT conv_id, turn, raw, trim(array_to_string(list_transform(string_split(cut, chr(10)), lambda x: trim(x)), chr(10)), ' ' || chr(10)) AS cleaned_body FROM q)"""

SQL = {
    "t2_clean_conversations": _CONV + " SELECT conv_id, turn, cleaned_body, length(raw) // 4 AS tokens_before, length(cleaned_body) // 4 AS tokens_after FROM d",
    "t3_signature": "SELECT s_suppkey, s_suppkey % 2 = 0 AS has_company, '+49 761 ' || s_suppkey AS phone FROM supplier",
    "t4_token_savings": _CONV + ", s AS (SELECT CAST(sum(length(raw) // 4) AS BIGINT) AS before, CAST(sum(length(cleaned_body) // 4) AS BIGINT) AS after FROM d) SELECT before, after, round((1 - after / before) * 100, 2) AS percent FROM s",
    "t7_parse_amount": inlined("inquiries")
    + """, k AS (SELECT id, CASE WHEN id % 3 = 2 THEN floor(debt_amount) ELSE floor(debt_amount) + (id % 100) / 100.0::DOUBLE END::DOUBLE AS v FROM inquiries)
     SELECT id, round(v, 2) AS value, round(v, 2) AS first FROM k""",
    "t9_names": inlined("texts") + " SELECT doc_id, regexp_replace(trim(regexp_extract(text, 'Mandant:\\s+([A-Za-zäöüÄÖÜß,\\s-]+)', 1)), '[,.\\s]+$', '') AS client, 'MEDIUM' AS client_confidence FROM texts WHERE doc_id % 8 = 1",
    "t10_normalize": inlined("texts") + r""" SELECT doc_id, 'Grüsse und schöne Tage' AS head, sha256(trim('Grüsse und schöne Tage ' || regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS whole FROM texts WHERE text IS NOT NULL""",
    "t11_validate": """SELECT c_custkey, length(CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(5, length(CAST(c_custkey AS VARCHAR))) AS INT), '0') ELSE CAST(c_custkey AS VARCHAR) END) = 5 AS code_ok,
       false AS name_ok, c_custkey % 2 = 0 AS street_ok FROM customer""",
    "t12_cells": """WITH g AS (SELECT l_orderkey AS k, l_linenumber AS c, min(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
     hits AS (SELECT a.k, coalesce(r.p, l.p) AS v FROM g a LEFT JOIN g r ON r.k = a.k AND r.c = a.c + 1 LEFT JOIN g l ON l.k = a.k AND l.c = a.c - 1 WHERE a.c % 2 = 1 AND a.k % 2 = 0)
     SELECT CAST(k AS VARCHAR) AS file, max(v) AS value, 'HIGH' AS confidence FROM hits WHERE v IS NOT NULL GROUP BY k""",
    "t13_attachments": inlined("sources")
    + """, p AS (SELECT *, CASE source_type WHEN 'email_body' THEN 'other' ELSE source_type END AS format, CASE source_type WHEN 'pdf' THEN 1 WHEN 'xlsx' THEN 3 WHEN 'image' THEN 4 ELSE 9 END AS place FROM sources)
     SELECT email_id, source_idx AS idx, format, CASE WHEN format = 'pdf' THEN (tokens_used % 20) / 1000 < 0.01 END AS scanned,
       100000 - coalesce(sum(tokens_used * 60) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 1000 AS processed, CAST(row_number() OVER w AS INT) AS rank
     FROM p WINDOW w AS (PARTITION BY email_id ORDER BY place, source_idx)""",
    "t15_model_json": inlined("emails")
    + """ SELECT id, CASE WHEN part % 4 = 0 THEN 'no_clear_response' ELSE intent END AS intent, CASE WHEN part % 4 = 0 THEN 0 ELSE confidence END AS confidence,
       round(CASE WHEN part % 2 = 0 THEN debt_amount ELSE debt_amount + 5 END, 2) AS total, CASE WHEN part % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS total_confidence FROM emails""",
    "t17_case_refs": inlined("texts") + " SELECT doc_id, CASE WHEN doc_id % 8 = 4 THEN CAST(doc_id + 10000 AS VARCHAR) ELSE '' END AS refs, CASE WHEN doc_id % 8 = 4 THEN 'second' ELSE 'first' END AS letter FROM texts",
    "t19_entity_guard": inlined("emails")
    + """ SELECT id, NOT (part % 5 = 0 AND part % 10 <> 0) AS is_creditor_reply, CASE WHEN part % 5 = 0 AND part % 10 <> 0 THEN 0 ELSE confidence END AS confidence,
       CASE WHEN NOT (part % 5 = 0 AND part % 10 <> 0) AND debt_amount * 10 <= 500000 THEN round(debt_amount * 10, 2) END AS debt_amount FROM emails""",
}
