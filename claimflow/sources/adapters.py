"""Domain tables made of the driver's TPC-H-like tables, in SQL that Spark and DuckDB read alike.

The library does not depend on them: they feed the registered queries and, inlined, their SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PREFIX = "CASE n_regionkey WHEN 0 THEN 'SC' WHEN 1 THEN 'KB' WHEN 2 THEN 'ES' WHEN 3 THEN 'MU' ELSE 'HH' END"

_INQUIRIES = f"""
SELECT *, kanzlei_prefix || '-' || lpad(CAST(creditor_idx AS STRING), 2, '0') || '-' ||
         CASE WHEN letter_type = 'second' THEN '2' ELSE '1' END || '-' || client_hash || '-' ||
         CASE WHEN id % 3 = 0 THEN 'k7p' ELSE 'K7P' END AS routing_id_raw,
       CASE WHEN id % 4 = 0 THEN 'v1' ELSE 'v2' END AS routing_id_version,
       CASE WHEN id % 4 = 0 THEN kanzlei_prefix || '-A' || CAST(custkey % 10000 AS STRING) || '-' || lpad(CAST(creditor_idx AS STRING), 2, '0')
            ELSE upper(kanzlei_prefix || '-' || lpad(CAST(creditor_idx AS STRING), 2, '0') || '-' ||
                 CASE WHEN letter_type = 'second' THEN '2' ELSE '1' END || '-' || client_hash || '-' ||
                 CASE WHEN id % 3 = 0 THEN 'k7p' ELSE 'm2x' END)
       END AS routing_id
FROM (
  SELECT o_orderkey AS id, o_custkey AS custkey, c_name AS client_name,
         'Creditor ' || CAST(o_custkey % 97 AS STRING) AS creditor_name,
         'svc' || CAST(o_custkey % 3 AS STRING) || '@cred' || CAST(o_custkey % 97 AS STRING) || '.example' AS creditor_email,
         o_totalprice AS debt_amount, 'AZ-' || CAST(o_orderkey AS STRING) AS reference_number,
         'msg-' || CAST(o_orderkey AS STRING) || '@mail.example' AS resend_message_id,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'em-' || CAST(o_orderkey % 7000 AS STRING) END AS resend_email_id,
         CASE WHEN o_orderkey % 5 = 0 THEN 'second' ELSE 'first' END AS letter_type,
         'k' || CAST(n_regionkey AS STRING) AS kanzlei_id, {PREFIX} AS kanzlei_prefix,
         CAST(o_orderkey % 12 AS INT) AS creditor_idx, 'c' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') AS client_hash,
         CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'sent' END AS status, o_orderdate AS sent_at
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
) base
"""

_EMAILS = f"""
SELECT l.oid * 10 + l.ln AS id, l.oid AS order_id, l.ln AS line, l.part, l.supp, i.custkey,
       CASE l.supp % 4 WHEN 0 THEN i.creditor_email WHEN 1 THEN 'Other@cred' || CAST(i.custkey % 97 AS STRING) || '.example'
            WHEN 2 THEN 'person' || CAST(l.part AS STRING) || '@gmail.com' ELSE 'x@nowhere' || CAST(l.supp AS STRING) || '.example' END AS from_email,
       CASE WHEN l.part % 3 = 0 THEN NULL ELSE i.kanzlei_id END AS kanzlei_id,
       i.sent_at + CAST(l.part % 120 AS INT) * INTERVAL '1' DAY AS received_at,
       CASE WHEN l.part % 7 = 0 THEN replace(i.client_name, '0', 'O') ELSE i.client_name END AS client_name,
       CASE WHEN l.part % 13 = 0 THEN NULL ELSE i.creditor_name END AS creditor_name,
       CASE WHEN l.supp % 2 = 0 THEN i.reference_number END AS reference_number,
       CASE WHEN l.supp % 5 = 0 THEN 'office+' || i.routing_id || '@reply.example' ELSE 'office@firm.example' END AS to_address,
       CASE WHEN l.supp % 7 = 0 THEN ' <' || i.resend_message_id || '> ' END AS in_reply_to,
       CASE WHEN l.supp % 6 = 0 THEN 'Re: ' || i.routing_id || ' claim'
            WHEN l.supp % 6 = 1 THEN 'Out of Office' ELSE 'Your letter' END AS subject,
       CASE WHEN l.part % 9 = 0 THEN 'See RAV-' || i.routing_id || ' above.' ELSE 'We answer your letter.' END AS body,
       l.price AS debt_amount, CAST(l.part % 101 AS DOUBLE) / 100 AS confidence,
       CASE l.part % 5 WHEN 0 THEN 'debt_statement' WHEN 1 THEN 'payment_plan' WHEN 2 THEN 'rejection' WHEN 3 THEN 'inquiry' ELSE 'auto_reply' END AS intent,
       CASE l.supp % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'received' WHEN 2 THEN 'parsed' WHEN 3 THEN 'not_creditor_reply' ELSE 'completed' END AS processing_status,
       i.routing_id, i.letter_type, i.sent_at
FROM (
  SELECT l_orderkey AS oid, l_linenumber AS ln, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_extendedprice) AS price
  FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber
) l JOIN ({_INQUIRIES}) i ON l.oid = i.id
"""

_SOURCES = """
SELECT l_orderkey AS email_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS source_idx,
       CASE l_linenumber % 4 WHEN 0 THEN 'email_body' WHEN 1 THEN 'pdf' WHEN 2 THEN 'xlsx' ELSE 'image' END AS source_type,
       CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE round(l_extendedprice, 2) END AS amount,
       CAST(l_linenumber % 3 + 1 AS INT) AS amount_tier,
       CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'MEDIUM' ELSE 'LOW' END AS amount_confidence,
       CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'Client ' || CAST(l_suppkey AS STRING) END AS client_name,
       CASE WHEN l_linestatus = 'F' THEN 'HIGH' ELSE 'MEDIUM' END AS client_name_confidence,
       l_partkey % 1000 AS tokens_used
FROM {lineitem}
"""

_METRICS = """
SELECT event_id AS id, event_type AS metric_type, value AS metric_value,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN '{{"queue": "q' || CAST(event_id % 3 AS STRING) || '"}}'
            WHEN event_id % 7 = 0 THEN '{{"stage": "s", "actor": "a' || CAST(event_id % 2 AS STRING) || '"}}' ELSE '{{"k": "' || CAST(event_id % 4 AS STRING) || '"}}' END AS labels,
       user_id AS email_id, ts AS recorded_at
FROM {events}
"""

_PROMPTS = """
SELECT event_id AS id, user_id % 10 AS prompt_template_id,
       CASE WHEN event_id % 3 = 0 THEN 'model-a' WHEN event_id % 3 = 1 THEN 'model-b' ELSE 'model-old' END AS model_name,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id % 700 END AS input_tokens,
       event_id % 90 AS output_tokens, CAST(event_id % 1000 AS DOUBLE) / 1000 AS api_cost_usd, event_type <> 'error' AS extraction_success,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) / 100 END AS confidence_score,
       event_type = 'view' AS manual_review_required, event_id % 5000 AS execution_time_ms, ts AS extracted_at
FROM {events}
"""

_CREDITORS = """
SELECT c_custkey AS client_id, 'AZ-' || CAST(c_custkey AS STRING) AS aktenzeichen, c_name AS client_name,
       o_orderkey AS creditor_id, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS INT) AS pos,
       'Creditor ' || CAST(o_orderkey % 97 AS STRING) AS sender_name,
       CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'svc@cred' || CAST(o_orderkey % 97 AS STRING) || '.example' END AS sender_email,
       o_totalprice AS claim_amount,
       CASE WHEN o_orderkey % 4 = 0 THEN round(o_totalprice + o_orderkey % 3, 2) END AS creditor_response_amount
FROM {customer} JOIN {orders} ON c_custkey = o_custkey
"""

_QUEUE = """
SELECT event_id AS id, event_id % 5000 AS email_id,
       CASE event_id % 6 WHEN 0 THEN 'manual_escalation' WHEN 1 THEN 'validation_failed' WHEN 2 THEN 'conflict_detected'
            WHEN 3 THEN 'low_confidence' WHEN 4 THEN 'missing_data' ELSE 'other' END AS review_reason,
       CAST(event_id % 10 + 1 AS INT) AS priority, CASE WHEN event_type = 'click' THEN ts END AS claimed_at,
       CASE WHEN event_type = 'purchase' THEN ts END AS resolved_at,
       CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'corrected' ELSE 'rejected' END END AS resolution,
       ts AS created_at
FROM {events}
"""

_TEXTS = """
SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN text || ' Gesamtforderung: ' || CAST(doc_id % 900 + 100 AS STRING) || ',50 EUR'
    WHEN 1 THEN 'Mandant: Hans Muster' || chr(10) || 'Betrag 1.' || CAST(doc_id % 900 + 100 AS STRING) || ',25 EUR offen.' || chr(10) || text
    WHEN 2 THEN 'noch zu zahlen: ' || CAST(doc_id AS STRING) || ' EUR, Summe 12,30 EUR' || chr(10) || text
    WHEN 3 THEN 'Tel 0761 EUR am 04.12.2024 EUR' || text
    WHEN 4 THEN 'Az: ' || CAST(doc_id + 10000 AS STRING) || ' Vergleich EUR ' || CAST(doc_id % 50 AS STRING) || ',00' || chr(10) || text
    ELSE text END AS text
FROM {documents}
"""

DOMAIN = {
    "inquiries": _INQUIRIES,
    "emails": _EMAILS,
    "sources": _SOURCES,
    "operational_metrics": _METRICS,
    "prompt_metrics": _PROMPTS,
    "creditors": _CREDITORS,
    "review_queue": _QUEUE,
    "texts": _TEXTS,
}

TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the tables in ``sf_dir``."""
    used = [t for t in TABLES if "{" + t + "}" in DOMAIN[name]]
    return spark.sql(DOMAIN[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def inlined(*names: str) -> str:
    """``WITH`` clause that defines the domain tables in plain SQL."""
    plain = {t: t for t in TABLES}
    return "WITH " + ", ".join(f"{name} AS ({DOMAIN[name].format(**plain)})" for name in names)
