"""Queries over clients, reconciliation and the review queue, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from claimflow.operators import review as rv
from claimflow.operators import writeback as wb
from claimflow.plans.jobs import audit_period
from claimflow.sources.adapters import domain, inlined

NOW = dt.datetime(1999, 6, 1)


def _clients(spark, sf):
    c = domain(spark, sf, "creditors").select("client_id", "aktenzeichen", "client_name").distinct()
    return c.select("client_id", F.replace("aktenzeichen", F.lit("-"), F.lit("_")).alias("aktenzeichen"), F.substring("client_name", 1, 8).alias("first_name"), F.substring("client_name", 10, 9).alias("last_name"), "client_name")


def k8_find_client(spark, sf):
    m = domain(spark, sf, "emails")
    case = F.when(F.col("part") % 3 == 0, F.concat(F.lit("AZ_"), F.col("custkey").cast("string"))).when(F.col("part") % 3 == 1, F.concat(F.lit("AZ/"), F.col("custkey").cast("string")))
    first = F.when(F.col("part") % 2 == 0, F.upper(F.substring("client_name", 1, 8))).otherwise(F.substring("client_name", 1, 8))
    keys = m.select("id", case.alias("aktenzeichen"), first.alias("first_name"), F.lpad(F.col("custkey").cast("string"), 9, "0").alias("last_name"))
    return wb.find_client(keys, _clients(spark, sf))


def _mails(spark, sf):
    m = domain(spark, sf, "emails")
    return m.select("id", F.col("custkey").alias("client_id"), "from_email", "creditor_name", F.when(F.col("part") % 11 == 0, 1).cast("int").alias("position"), F.col("debt_amount"), F.col("received_at").alias("created_at"), "processing_status", "client_name", "part", "supp")


def k9_find_creditor(spark, sf):
    return wb.find_creditor(_mails(spark, sf), domain(spark, sf, "creditors"))


def k10_overlap(spark, sf):
    m = _mails(spark, sf).withColumn("creditor_name", F.concat("creditor_name", F.lit(" Nord Bank")))
    return wb.find_creditor_by_overlap(m, domain(spark, sf, "creditors"))


def k11_apply_amounts(spark, sf):
    c = domain(spark, sf, "creditors")
    none = lambda kind: F.lit(None).cast(kind)
    element = F.struct("pos", F.col("creditor_id").alias("id"), "claim_amount", none("double").alias("current_debt_amount"), none("double").alias("creditor_response_amount"), none("string").alias("amount_source"), none("string").alias("contact_status"))
    clients = c.groupBy("client_id").agg(F.array_sort(F.collect_list(element)).alias("final_creditor_list"))
    mails = _mails(spark, sf).withColumns({"at": F.struct(F.col("created_at").alias("at"), "id"), "amount": F.col("debt_amount")})
    approved = wb.find_creditor(mails, c, carried=("at", "amount"))
    after = wb.apply_amounts(clients, approved).select("client_id", F.posexplode("final_creditor_list").alias("pos", "e"))
    return after.select("client_id", "pos", "e.id", "e.claim_amount", "e.current_debt_amount", "e.amount_source")


def k12_settlements(spark, sf):
    c = domain(spark, sf, "creditors")
    none = lambda kind: F.lit(None).cast(kind)
    element = F.struct("pos", "claim_amount", none("string").alias("settlement_response_status"), none("double").alias("settlement_counter_offer_amount"), none("string").alias("settlement_response_conditions"))
    clients = c.groupBy("client_id").agg(F.array_sort(F.collect_list(element)).alias("final_creditor_list"))
    decision = F.when(F.col("part") % 2 == 0, "accepted").otherwise("counter_offer")
    m = _mails(spark, sf).withColumns({"at": F.struct("created_at", "id"), "decision": decision, "offer": F.col("debt_amount"), "conditions": F.lit("sofern")})
    found = wb.find_creditor(m, c, carried=("at", "decision", "offer", "conditions"))
    after = wb.apply_settlements(clients, found).select("client_id", F.posexplode("final_creditor_list").alias("pos", "e"))
    return after.select("client_id", "pos", "e.claim_amount", F.col("e.settlement_response_status").alias("status"), F.col("e.settlement_counter_offer_amount").alias("offer"))


def k13_outbox(spark, sf):
    m = domain(spark, sf, "emails")
    a = m.select("id", F.col("received_at").alias("at"), F.concat(F.lit("k"), (F.col("order_id") % 500).cast("string")).alias("idempotency_key"))
    return wb.build_outbox(a, a.where("id % 7 = 0").distinct()).select("id", "idempotency_key")


def k14_backfill(spark, sf):
    i = domain(spark, sf, "inquiries").withColumn("reference_number", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("reference_number")))
    return wb.backfill_references(i, domain(spark, sf, "creditors")).select("id", "reference_number", "updated")


def x1_reconcile(spark, sf):
    m = _mails(spark, sf).withColumn("client_id", F.when(F.col("part") % 50 == 0, -1).otherwise(F.col("client_id")))
    return wb.reconcile(m, domain(spark, sf, "creditors"), NOW, hours=24 * 400).select("id", "kind", "stored_amount")


def x2_reconcile_summary(spark, sf):
    bad = x1_reconcile(spark, sf)
    return wb.reconcile_summary(bad, bad.select("id", (F.col("id") % 5 != 0).alias("success")))


def x3_outbox(spark, sf):
    q = domain(spark, sf, "review_queue")
    box = q.select("id", F.col("resolved_at").alias("processed_at"), (F.col("id") % 4).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"), F.lit(None).cast("string").alias("error_message"))
    results = q.where("id % 2 = 0").select("id", (F.col("id") % 3 != 0).alias("success"), F.lit("timeout").alias("error"))
    return wb.outbox_step(box, results, dt.datetime(2024, 3, 1))


def x4_audit(spark, sf):
    return wb.audit(_mails(spark, sf), domain(spark, sf, "creditors"), NOW, days=400)


def x5_audit_summary(spark, sf):
    return audit_period(_mails(spark, sf), domain(spark, sf, "creditors"), NOW, days=400)


def x6_audit_samples(spark, sf):
    return wb.audit_samples(x4_audit(spark, sf)).select("id", "issue")


def q1_enqueue(spark, sf):
    q = domain(spark, sf, "review_queue")
    items = q.select((F.col("id") % 9000).alias("email_id"), F.when(F.col("id") % 30 != 0, F.col("review_reason")).alias("review_reason"), F.col("created_at").alias("at"))
    mails = q.select((F.col("id") % 8000).alias("id"))
    return rv.enqueue_reviews(items, q, mails).groupBy("outcome", "priority").agg(F.count("*").alias("items"))


def q2_low_confidence(spark, sf):
    m = domain(spark, sf, "emails")
    stage = lambda c: F.struct(c.alias("confidence"), (F.col("supp") % 9 == 0).alias("needs_review"))
    points = F.create_map(F.lit("intent"), stage(F.col("confidence")), F.lit("entity"), stage(F.col("supp") % 10 / 10))
    return rv.low_confidence_items(m.withColumn("checkpoints", points), NOW, hours=24 * 200)


def q3_pending(spark, sf):
    return rv.pending_reviews(domain(spark, sf, "review_queue"), 50, claimed=False).select("id", "priority", "created_at")


def q4_queue_stats(spark, sf):
    return rv.queue_stats(domain(spark, sf, "review_queue"))


def _samples(spark, sf):
    q = domain(spark, sf, "review_queue").where("resolution IS NOT NULL")
    fields = {"confidence": F.col("id") % 100 / 100, "document_type": F.when(F.col("id") % 2 == 0, "pdf").otherwise("email"), "amount": F.lit(5.0), "corrected_amount": F.when(F.col("id") % 4 == 0, 6.0), "client_name": F.lit("a"), "corrected_client_name": F.when(F.col("id") % 8 == 0, "b"), "creditor_name": F.lit("c"), "corrected_creditor_name": F.lit(None).cast("string")}
    return rv.calibration_samples(q.withColumns(fields))


def q5_calibration(spark, sf):
    return _samples(spark, sf)


def q6_calibration_summary(spark, sf):
    return rv.calibration_summary(_samples(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


def q7_reports(spark, sf):
    r = rv.processing_reports(domain(spark, sf, "emails"))
    return r.select("id", "confidence", F.array_join("missing_fields", ",").alias("missing"), "needs_review")


def q8_reports(spark, sf):
    r = rv.processing_reports(domain(spark, sf, "emails"))
    return rv.reports_needing_review(rv.reports_by_range(r, dt.datetime(1998, 1, 1), dt.datetime(1999, 1, 1))).select("id", "received_at")


def q9_job_status(spark, sf):
    return rv.job_status(domain(spark, sf, "emails"))


def q9_newest_jobs(spark, sf):
    return rv.newest_jobs(domain(spark, sf, "emails"))


def q10_reprocess(spark, sf):
    m = domain(spark, sf, "emails").withColumn("retry_count", F.lit(None).cast("int"))
    return rv.select_reprocess(m, dt.datetime(1998, 1, 1), True).select("id", "processing_status", "retry_count")


def q11_recent_inquiries(spark, sf):
    return rv.recent_inquiries(domain(spark, sf, "inquiries"), 20, 30).select("id", "sent_at")


def q12_eval_sample(spark, sf):
    return rv.sample_for_eval(domain(spark, sf, "emails"), NOW)


QUERIES = {
    f.__name__: f
    for f in (
        k8_find_client, k9_find_creditor, k10_overlap, k11_apply_amounts, k12_settlements, k13_outbox, k14_backfill, x1_reconcile, x2_reconcile_summary, x3_outbox, x4_audit, x5_audit_summary, x6_audit_samples,
        q1_enqueue, q2_low_confidence, q3_pending, q4_queue_stats, q5_calibration, q6_calibration_summary, q7_reports, q8_reports, q9_job_status, q9_newest_jobs, q10_reprocess, q11_recent_inquiries, q12_eval_sample,
    )
}

_BOTH = inlined("emails", "creditors")
_FITS = """(lower(m.from_email) <> '' AND c.sender_email <> '' AND (contains(lower(m.from_email), c.sender_email) OR contains(c.sender_email, lower(m.from_email))
   OR split_part(lower(m.from_email), '@', 2) = split_part(c.sender_email, '@', 2))) OR coalesce(m.creditor_name IS NOT NULL, false)"""
# every creditor name here holds the word "creditor", so any named mail fits its client's first entry
_FOUND = """m AS (SELECT *, custkey AS client_id FROM emails),
 fits AS (SELECT m.id, m.client_id, c.pos, CASE WHEN m.part % 11 = 0 AND c.pos = 1 THEN 0 ELSE 1 END AS off FROM m JOIN creditors c USING (client_id)
   WHERE (m.part % 11 = 0 AND c.pos = 1) OR """ + _FITS + """),
 found AS (SELECT id, client_id, arg_min(pos, (off, pos)) AS pos FROM fits GROUP BY 1, 2)"""
_RECON = """m AS (SELECT *, {client} AS client_id FROM emails WHERE received_at BETWEEN TIMESTAMP '1999-06-01' - INTERVAL 400 DAY AND TIMESTAMP '1999-06-01' {more}),
 fits AS (SELECT m.id, min(c.pos) AS pos, m.client_id FROM m JOIN creditors c USING (client_id) WHERE """ + _FITS + """ GROUP BY m.id, m.client_id),
 bad AS (SELECT m.id, CASE WHEN m.client_id NOT IN (SELECT client_id FROM creditors) THEN 'missing_in_mongo' WHEN f.pos IS NULL THEN 'missing_creditor_in_mongo'
   WHEN abs(m.debt_amount - coalesce(c.creditor_response_amount, c.claim_amount)) > 0.01 THEN 'data_mismatch' END AS kind, coalesce(c.creditor_response_amount, c.claim_amount) AS stored_amount
   FROM m LEFT JOIN fits f ON f.id = m.id LEFT JOIN creditors c ON c.client_id = f.client_id AND c.pos = f.pos)"""
_X1 = _RECON.format(client="CASE WHEN part % 50 = 0 THEN -1 ELSE custkey END", more="")
_AUDIT = _RECON.format(client="custkey", more="AND processing_status = 'completed'") + """, p AS (SELECT * FROM emails WHERE received_at BETWEEN TIMESTAMP '1999-06-01' - INTERVAL 400 DAY AND TIMESTAMP '1999-06-01'),
 issues AS (SELECT p.id, CASE WHEN processing_status IN ('received', 'parsed') AND received_at < TIMESTAMP '1999-05-31' THEN 'stalled' WHEN processing_status = 'failed' THEN 'processing_failed'
   WHEN kind IN ('missing_in_mongo', 'missing_creditor_in_mongo') THEN 'pg_matched_no_mongo_record' WHEN kind = 'data_mismatch' THEN 'amount_mismatch' END AS issue
   FROM p LEFT JOIN bad ON bad.id = p.id AND bad.kind IS NOT NULL)"""
_REPORTS = """r AS (SELECT id, received_at, confidence, concat_ws(',', CASE WHEN creditor_name IS NULL THEN 'creditor_name' END, CASE WHEN reference_number IS NULL THEN 'reference_numbers' END) AS missing FROM emails),
 reports AS (SELECT *, missing <> '' OR confidence < 0.7 AS needs_review FROM r)"""
_SAMPLES = """s AS (SELECT email_id, resolution = 'approved' AS was_correct, CASE WHEN resolution <> 'approved' THEN CASE WHEN id % 8 = 0 THEN 'multiple' WHEN id % 4 = 0 THEN 'amount_corrected' ELSE 'none' END END AS correction_type,
   CASE WHEN id % 100 / 100 >= 0.85 THEN 'high' WHEN id % 100 / 100 >= 0.6 THEN 'medium' ELSE 'low' END AS bucket, CASE WHEN id % 2 = 0 THEN 'pdf' ELSE 'email' END AS document_type
   FROM review_queue WHERE resolution IN ('approved', 'corrected'))"""

SQL = {
    "k8_find_client": inlined("emails", "creditors")
    + """, c AS (SELECT DISTINCT client_id FROM creditors)
     SELECT id, custkey AS client_id, CASE WHEN part % 3 = 0 THEN 'case_number' WHEN part % 3 = 1 THEN 'case_number_variant' WHEN part % 2 = 0 THEN 'name_without_case' ELSE 'name' END AS found_by
     FROM emails WHERE custkey IN (SELECT client_id FROM c)""",
    "k9_find_creditor": f"{_BOTH}, {_FOUND} SELECT * FROM found",
    "k10_overlap": _BOTH
    + """, s AS (SELECT e.id, c.pos, CASE WHEN contains(lower(e.creditor_name) || ' nord bank', lower(c.sender_name)) THEN 2.0
         ELSE (1 + CAST(length(split_part(c.sender_name, ' ', 2)) > 2 AND split_part(e.creditor_name, ' ', 2) = split_part(c.sender_name, ' ', 2) AS INT)) / (3 + CAST(length(split_part(e.creditor_name, ' ', 2)) > 2 AS INT)) END AS score
       FROM emails e JOIN creditors c ON c.client_id = e.custkey WHERE e.creditor_name IS NOT NULL)
     SELECT id, arg_max(pos, (score, -pos)) AS pos, round(max(score), 6)::DOUBLE AS score FROM s WHERE score >= 0.4 GROUP BY id""",
    "k11_apply_amounts": f"""{_BOTH}, {_FOUND}, u AS (SELECT f.client_id, f.pos, arg_max(e.debt_amount, (e.received_at, e.id)) AS amount FROM found f JOIN emails e USING (id) GROUP BY 1, 2)
     SELECT c.client_id, c.pos, creditor_id AS id, claim_amount, amount AS current_debt_amount, CASE WHEN amount IS NOT NULL THEN 'creditor_response' END AS amount_source FROM creditors c LEFT JOIN u ON u.client_id = c.client_id AND u.pos = c.pos""",
    "k12_settlements": f"""{_BOTH}, {_FOUND}, u AS (SELECT f.client_id, f.pos, arg_max((CASE WHEN part % 2 = 0 THEN 'accepted' ELSE 'counter_offer' END, e.debt_amount), (e.received_at, e.id)) AS v FROM found f JOIN emails e USING (id) GROUP BY 1, 2)
     SELECT c.client_id, c.pos, claim_amount, v[1] AS status, v[2] AS offer FROM creditors c LEFT JOIN u ON u.client_id = c.client_id AND u.pos = c.pos""",
    "k13_outbox": inlined("emails")
    + """, a AS (SELECT id, received_at AS moment, 'k' || (order_id % 500) AS idempotency_key FROM emails)
     SELECT id, idempotency_key FROM a WHERE idempotency_key NOT IN (SELECT idempotency_key FROM a WHERE id % 7 = 0) QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY moment, id) = 1""",
    "k14_backfill": inlined("inquiries", "creditors")
    + """, c AS (SELECT client_name, min(aktenzeichen) AS az FROM creditors GROUP BY 1)
     SELECT id, CASE WHEN id % 3 = 0 THEN az ELSE reference_number END AS reference_number, id % 3 = 0 AND az IS NOT NULL AS updated FROM inquiries LEFT JOIN c USING (client_name)""",
    "x1_reconcile": f"{_BOTH}, {_X1} SELECT id, kind, stored_amount FROM bad WHERE kind IS NOT NULL",
    "x2_reconcile_summary": f"{_BOTH}, {_X1} SELECT count(*) FILTER (kind IN ('missing_in_mongo', 'data_mismatch')) AS mismatches_found, count(*) FILTER (id % 5 <> 0) AS repaired, count(*) FILTER (id % 5 = 0) AS failed FROM bad WHERE kind IS NOT NULL",
    "x3_outbox": inlined("review_queue")
    + """, k AS (SELECT id, resolved_at, CAST(id % 4 AS INT) AS r, resolved_at IS NULL AND id % 4 < 3 AND id % 2 = 0 AS asked FROM review_queue)
     SELECT id, CASE WHEN asked AND id % 3 <> 0 THEN TIMESTAMP '2024-03-01' ELSE resolved_at END AS processed_at, r + CAST(asked AND id % 3 = 0 AS INT) AS retry_count, 3 AS max_retries,
       CASE WHEN asked AND id % 3 = 0 THEN 'timeout' END AS error_message FROM k""",
    "x4_audit": f"""{_BOTH}, {_AUDIT} SELECT id, issue, CASE WHEN issue IN ('pg_matched_no_mongo_record', 'processing_failed') THEN 'high' ELSE 'medium' END AS severity,
       CASE WHEN issue IN ('stalled', 'processing_failed') THEN 'reprocess' ELSE 'resync' END AS action FROM issues WHERE issue IS NOT NULL""",
    "x5_audit_summary": f"""{_BOTH}, {_AUDIT} SELECT count(*) FILTER (issue = 'stalled') AS stalled, count(*) FILTER (issue = 'processing_failed') AS processing_failed, CAST(0 AS BIGINT) AS incomplete_extraction,
       count(*) FILTER (issue = 'pg_matched_no_mongo_record') AS pg_matched_no_mongo_record, count(*) FILTER (issue = 'amount_mismatch') AS amount_mismatch,
       round(greatest(0, (any_value(n) - count(issue)) / any_value(n)::DOUBLE), 6) AS health, round(greatest(0, (any_value(n) - count(issue)) / any_value(n)::DOUBLE), 6) >= 0.95 AS healthy
       FROM issues, (SELECT count(*) AS n FROM emails WHERE received_at BETWEEN TIMESTAMP '1999-06-01' - INTERVAL 400 DAY AND TIMESTAMP '1999-06-01') p""",
    "x6_audit_samples": f"{_BOTH}, {_AUDIT} SELECT id, issue FROM issues WHERE issue IS NOT NULL QUALIFY row_number() OVER (PARTITION BY issue ORDER BY id) <= 5",
    "q1_enqueue": inlined("review_queue")
    + """, i AS (SELECT id % 9000 AS e, CASE WHEN id % 30 <> 0 THEN review_reason END AS r, created_at AS moment FROM review_queue),
     o AS (SELECT DISTINCT email_id FROM review_queue WHERE resolved_at IS NULL), k AS (SELECT DISTINCT id % 8000 AS id FROM review_queue),
     s AS (SELECT *, CASE WHEN r IS NULL OR e NOT IN (SELECT id FROM k) THEN 'failed' WHEN e IN (SELECT email_id FROM o) THEN 'skipped' END AS x FROM i),
     t AS (SELECT *, coalesce(x, CASE WHEN row_number() OVER (PARTITION BY e, x ORDER BY moment, r) = 1 THEN 'added' ELSE 'skipped' END) AS outcome FROM s)
     SELECT outcome, CASE r WHEN 'manual_escalation' THEN 1 WHEN 'validation_failed' THEN 2 WHEN 'conflict_detected' THEN 3 WHEN 'missing_data' THEN 6 ELSE 5 END AS priority, count(*) AS items FROM t GROUP BY 1, 2""",
    "q2_low_confidence": inlined("emails")
    + """, k AS (SELECT id, supp, CASE WHEN (supp % 10 / 10)::DOUBLE <= confidence THEN 'entity' ELSE 'intent' END AS stage, least(confidence, (supp % 10 / 10)::DOUBLE) AS confidence FROM emails
       WHERE processing_status = 'completed' AND received_at BETWEEN TIMESTAMP '1999-06-01' - INTERVAL 200 DAY AND TIMESTAMP '1999-06-01')
     SELECT id, stage, confidence FROM k WHERE supp % 9 = 0 OR confidence < 0.7""",
    "q3_pending": inlined("review_queue") + " SELECT id, priority, created_at FROM review_queue WHERE resolved_at IS NULL AND claimed_at IS NULL ORDER BY priority, created_at, id LIMIT 50",
    "q4_queue_stats": inlined("review_queue")
    + """ SELECT review_reason, priority, count(*) FILTER (resolved_at IS NULL AND claimed_at IS NULL) AS pending, count(*) FILTER (resolved_at IS NULL AND claimed_at IS NOT NULL) AS claimed,
       count(*) FILTER (resolved_at IS NOT NULL) AS resolved FROM review_queue GROUP BY GROUPING SETS ((review_reason), (priority), ())""",
    "q5_calibration": inlined("review_queue") + f", {_SAMPLES} SELECT * FROM s",
    "q6_calibration_summary": inlined("review_queue") + f", {_SAMPLES} SELECT bucket, document_type, count(*) AS samples, round(avg(CAST(was_correct AS DOUBLE)), 6) AS accuracy FROM s GROUP BY ROLLUP (bucket, document_type)",
    "q7_reports": inlined("emails") + f", {_REPORTS} SELECT id, confidence, missing, needs_review FROM reports",
    "q8_reports": inlined("emails") + f", {_REPORTS} SELECT id, received_at FROM reports WHERE needs_review AND received_at >= TIMESTAMP '1998-01-01' AND received_at < TIMESTAMP '1999-01-01' ORDER BY received_at DESC, id LIMIT 100",
    "q9_job_status": inlined("emails")
    + """, s(processing_status) AS (VALUES ('received'), ('parsed'), ('processing'), ('completed'), ('failed'), ('not_creditor_reply'))
     SELECT s.processing_status, count(e.id) AS mails FROM s LEFT JOIN emails e USING (processing_status) GROUP BY 1""",
    "q9_newest_jobs": inlined("emails") + " SELECT id, received_at, subject, processing_status FROM emails ORDER BY received_at DESC, id LIMIT 20",
    "q10_reprocess": inlined("emails") + " SELECT id, 'received' AS processing_status, 1 AS retry_count FROM emails WHERE processing_status IN ('failed', 'not_creditor_reply') AND received_at >= TIMESTAMP '1998-01-01'",
    "q11_recent_inquiries": inlined("inquiries") + " SELECT id, sent_at FROM inquiries ORDER BY sent_at DESC, id LIMIT 30 OFFSET 20",
    "q12_eval_sample": inlined("emails") + " SELECT id, subject, body, from_email FROM emails WHERE received_at BETWEEN TIMESTAMP '1999-06-01' - INTERVAL 60 DAY AND TIMESTAMP '1999-06-01' ORDER BY received_at DESC, id LIMIT 100",
}
