"""Queries over consolidation, confidence and guards, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimflow.operators import confidence as conf
from claimflow.operators import consolidate as cons
from claimflow.sources.adapters import domain, inlined


def k1_extraction_confidence(spark, sf):
    src = domain(spark, sf, "sources")
    kinds = src.groupBy("email_id").agg(
        F.collect_set(F.when(F.col("source_type") == "pdf", "native_pdf").otherwise(F.col("source_type"))).alias("types"),
        F.max("amount").alias("amount"), F.max("client_name").alias("client"), F.max(F.when(F.col("tokens_used") > 500, "x")).alias("creditor"),
    )
    return kinds.select("email_id", conf.extraction_confidence(F.col("types"), F.col("amount"), F.col("client"), F.col("creditor")).alias("confidence"))


def k3_overall_route(spark, sf):
    m = domain(spark, sf, "emails")
    status = F.when(F.col("part") % 4 == 0, "ambiguous").when(F.col("part") % 4 == 1, "auto_matched").when(F.col("part") % 4 == 2, "below_threshold").otherwise("no_candidates")
    matched = conf.match_confidence(status, F.col("confidence"))
    m = m.select("id", F.round(matched, 6).alias("match"), F.lit(0.8).alias("extraction"), (F.col("supp") % 10 / 10).alias("intent_score"))
    low, weak = conf.overall_confidence(F.col("extraction"), F.col("match"), F.col("intent_score"))
    m = m.withColumn("overall", low).withColumn("weakest", weak).withColumn("route", conf.route_by_confidence(F.col("overall")))
    return m.select("id", "overall", "weakest", "route.level", "route.action", "route.expiry_days")


def k5_amount_guard(spark, sf):
    m = domain(spark, sf, "emails")
    new = F.when(F.col("part") % 17 != 0, F.when(F.col("part") % 23 == 0, F.lit(600000.5)).otherwise(F.col("debt_amount")))
    old = F.when(F.col("supp") % 3 != 0, F.lit(30000.0))
    return m.select("id", conf.amount_guard(old, new, F.col("confidence")).alias("reason"))


def k6_intent_gate(spark, sf):
    return conf.intent_gate(domain(spark, sf, "emails")).groupBy("intent").agg(F.count("*").alias("mails"))


def k7_replay(spark, sf):
    m = domain(spark, sf, "emails").select("id", "custkey", F.col("debt_amount").alias("new_amount"), "confidence", F.col("received_at").alias("at"), F.lit(20000.0).alias("initial"))
    return conf.replay_amount_updates(m, ["custkey"], 0.5, 60_000).select("id", "custkey", "existing", "reason", "accepted")


def c5_consolidate(spark, sf):
    found = cons.consolidate(domain(spark, sf, "sources"))
    return found.withColumn("unique_amounts", F.size("unique_amounts"))


def c6_best_name(spark, sf):
    return cons.pick_best_name(domain(spark, sf, "sources"))


def c7_majority(spark, sf):
    src = domain(spark, sf, "sources").withColumn("amount", F.floor(F.col("amount") / 30000) * 30000.0)
    return cons.majority_vote(src)


def _pairs(spark, sf):
    m = domain(spark, sf, "emails")
    i = domain(spark, sf, "inquiries").select(F.col("id").alias("order_id"), F.col("debt_amount").alias("existing_amount"), F.col("client_name").alias("existing_client"), F.col("creditor_name").alias("existing_creditor"))
    return m.join(i, "order_id").select("id", F.col("debt_amount").alias("new_amount"), "existing_amount", F.col("client_name").alias("new_client"), "existing_client", F.col("creditor_name").alias("new_creditor"), "existing_creditor")


def c8_conflicts(spark, sf):
    found = cons.detect_conflicts(_pairs(spark, sf))
    return found.select("id", F.explode("conflicts").alias("c")).select("id", "c.type", "c.difference_percent")


def c9_validate(spark, sf):
    m = domain(spark, sf, "emails")
    raw = m.select("id", F.when(F.col("part") % 6 == 0, "n/a").otherwise(F.col("debt_amount").cast("string")).alias("amount"), F.when(F.col("part") % 5 == 0, "1.5").otherwise(F.col("confidence").cast("string")).alias("confidence"), "intent")
    found = cons.validate_partial(raw)
    return found.select("id", "amount", "confidence", "intent", F.array_join("errors", ",").alias("errors"), "needs_review")


def c10_checkpoint(spark, sf):
    found = cons.consolidate(domain(spark, sf, "sources"))
    conflicts = F.when(F.col("email_id") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return found.select("email_id", cons.checkpoint(F.col("confidence"), conflicts).alias("c")).select("email_id", "c.confidence", "c.needs_review")


def c14_case_number(spark, sf):
    m = domain(spark, sf, "emails")
    refs = F.array(F.lit("AZ"), F.lit("12"), F.when(F.col("part") % 2 == 0, F.concat(F.lit("20/"), F.col("order_id").cast("string"))), F.lit("99-99"))
    return m.select("id", cons.case_number(refs).alias("case_number"))


def c11_merge(spark, sf):
    p = cons.consolidate(domain(spark, sf, "sources")).select("email_id", "amount").join(cons.pick_best_name(domain(spark, sf, "sources")), "email_id", "left")
    m = domain(spark, sf, "emails")
    p = p.withColumnRenamed("email_id", "order_id").join(m.select("order_id", F.col("id").alias("email_id")), "order_id").drop("order_id")
    e = m.select(F.col("id").alias("email_id"), F.col("debt_amount").alias("amount"), "client_name", "intent", (F.col("part") % 2 == 0).alias("is_creditor_reply"))
    return cons.merge_extractions(p, e)


def c12_match_gate(spark, sf):
    return cons.match_gate(domain(spark, sf, "emails").withColumn("client_name", F.when(F.col("part") % 2 == 0, F.col("client_name")))).select("id")


def c13_settlement(spark, sf):
    m = domain(spark, sf, "emails")
    decision = F.when(F.col("part") % 3 == 0, "counter_offer").when(F.col("part") % 3 == 1, "accepted").otherwise("rejected")
    offer = F.when(F.col("supp") % 4 == 0, F.lit(-5.0)).when(F.col("supp") % 4 == 1, F.col("debt_amount"))
    conditions = F.when(F.col("supp") % 5 == 0, "Sofern alle zustimmen").when(F.col("supp") % 5 == 1, "keine")
    warnings = cons.settlement_warnings(decision, offer, conditions, F.when(F.col("part") % 7 != 0, F.lit(10000.0)))
    return m.select("id", F.array_join(warnings, ",").alias("warnings"), ((F.size(warnings) > 0) | (F.col("confidence") < 0.7)).alias("needs_review"))


QUERIES = {f.__name__: f for f in (k1_extraction_confidence, k3_overall_route, k5_amount_guard, k6_intent_gate, k7_replay, c5_consolidate, c6_best_name, c7_majority, c8_conflicts, c9_validate, c10_checkpoint, c11_merge, c12_match_gate, c13_settlement, c14_case_number)}

_GRADE = "CASE {} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
_BEST_NAME = """SELECT email_id, arg_max(client_name, (CAST(client_name_confidence = 'HIGH' AS INT), length(client_name), -source_idx)) AS client_name
  FROM sources WHERE client_name IS NOT NULL GROUP BY email_id"""
_CONSOLIDATED = """SELECT email_id, arg_min(amount, (amount_tier, -amount, source_idx)) FILTER (amount IS NOT NULL) AS amount,
  count(*) AS source_count, CAST(sum(coalesce(tokens_used, 0)) AS BIGINT) AS tokens,
  CASE WHEN bool_or(amount IS NOT NULL AND source_type IN ('pdf', 'docx', 'xlsx', 'image')) THEN 'ai_primary' WHEN count(amount) > 0 THEN 'regex_fallback' ELSE 'none' END AS method,
  CASE WHEN count(amount) = 0 THEN 1 ELSE least(min({a}) FILTER (amount IS NOT NULL), min({n}) FILTER (client_name IS NOT NULL)) END AS weakest,
  list(amount ORDER BY amount_tier, -amount, source_idx) FILTER (amount IS NOT NULL) AS amounts
  FROM sources GROUP BY email_id""".format(a=_GRADE.format("amount_confidence"), n=_GRADE.format("client_name_confidence"))

SQL = {
    "k1_extraction_confidence": inlined("sources")
    + """, k AS (SELECT email_id, min(CASE source_type WHEN 'pdf' THEN 0.95 WHEN 'xlsx' THEN 0.85 WHEN 'email_body' THEN 0.80 ELSE 0.70 END)::DOUBLE AS b,
       CAST(max(amount) IS NULL AS INT) + CAST(max(client_name) IS NULL AS INT) + CAST(max(tokens_used) <= 500 AS INT) AS missing FROM sources GROUP BY 1)
     SELECT email_id, round(least(greatest(b - missing * 0.1::DOUBLE, 0.3::DOUBLE), 1.0::DOUBLE), 6) AS confidence FROM k""",
    "k3_overall_route": inlined("emails")
    + """, k AS (SELECT id, round(CASE part % 4 WHEN 0 THEN confidence * 0.7::DOUBLE WHEN 3 THEN 0.0::DOUBLE ELSE confidence END, 6) AS m, 0.8::DOUBLE AS x,
       CASE WHEN supp % 10 > 0 THEN (supp % 10 / 10)::DOUBLE END AS i FROM emails), o AS (SELECT *, least(x, m, i) AS overall FROM k)
     SELECT id, overall, CASE WHEN x = overall THEN 'extraction' WHEN m = overall THEN 'match' ELSE 'intent' END AS weakest,
       CASE WHEN overall >= 0.85 THEN 'high' WHEN overall >= 0.6 THEN 'medium' ELSE 'low' END AS level,
       CASE WHEN overall >= 0.85 THEN 'auto_update' WHEN overall >= 0.6 THEN 'update_and_notify' ELSE 'manual_review' END AS action,
       CASE WHEN overall >= 0.6 THEN NULL ELSE 7 END AS expiry_days FROM o""",
    "k5_amount_guard": inlined("emails")
    + """, k AS (SELECT id, confidence AS c, CASE WHEN part % 17 <> 0 THEN CASE WHEN part % 23 = 0 THEN 600000.5 ELSE debt_amount END END AS n, CASE WHEN supp % 3 <> 0 THEN 30000.0 END AS o FROM emails)
     SELECT id, CASE WHEN n IS NULL THEN 'extraction_returned_none' WHEN n > 500000 THEN 'implausible_amount_600000.50_exceeds_500000' WHEN c < 0.75 THEN 'low_extraction_confidence'
       WHEN o IS NOT NULL AND n < o THEN 'amount_downgrade_prevented' ELSE 'amount_update_approved' END AS reason FROM k""",
    "k6_intent_gate": inlined("emails") + " SELECT intent, count(*) AS mails FROM emails WHERE intent IN ('debt_statement', 'payment_plan') GROUP BY 1",
    "k7_replay": inlined("emails")
    + """, r AS (SELECT id, custkey, debt_amount AS n, confidence AS c, greatest(20000.0::DOUBLE, max(CASE WHEN debt_amount <= 60000 AND confidence >= 0.5 THEN debt_amount END)
         OVER (PARTITION BY custkey ORDER BY received_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS existing FROM emails),
       d AS (SELECT *, CASE WHEN n > 60000 THEN 'implausible_amount_' || printf('%.2f', n) || '_exceeds_60000' WHEN c < 0.5 THEN 'low_extraction_confidence'
         WHEN n < existing THEN 'amount_downgrade_prevented' ELSE 'amount_update_approved' END AS reason FROM r)
     SELECT id, custkey, existing, reason, reason = 'amount_update_approved' AS accepted FROM d""",
    "c5_consolidate": inlined("sources")
    + f""", c AS ({_CONSOLIDATED})
     SELECT email_id, amount, coalesce(len(list_reduce(list_transform(amounts, lambda x: [x]), lambda k, v: CASE WHEN len(list_filter(k, lambda y: abs(y - v[1]) < 1)) > 0 THEN k ELSE list_concat(k, v) END)), 0) AS unique_amounts,
       method, source_count, tokens, CASE weakest WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM c""",
    "c6_best_name": inlined("sources") + " " + _BEST_NAME,
    "c7_majority": inlined("sources")
    + """, v AS (SELECT email_id, floor(amount / 30000) * 30000.0 AS value, count(amount) AS votes, min(source_idx) AS first FROM sources GROUP BY 1, 2),
       b AS (SELECT email_id, arg_max(coalesce(value, -1), (votes, -first)) AS value, max(votes) AS votes, sum(votes) AS total FROM v GROUP BY 1)
     SELECT email_id, CASE WHEN total = 0 THEN 0.0 ELSE value END::DOUBLE AS value, CASE WHEN total = 0 THEN 0.0 ELSE round(votes / total, 2) END::DOUBLE AS share FROM b""",
    "c8_conflicts": inlined("emails", "inquiries")
    + """, p AS (SELECT m.id, m.debt_amount AS n, i.debt_amount AS o, m.client_name AS nc, i.client_name AS oc, m.creditor_name AS nr, i.creditor_name AS orr FROM emails m JOIN inquiries i ON m.order_id = i.id)
     SELECT id, 'amount_mismatch' AS type, round(abs(n - o) / o * 100, 2) AS difference_percent FROM p WHERE o > 0 AND abs(n - o) / o * 100 > 10
     UNION ALL SELECT id, 'client_name_mismatch', NULL FROM p WHERE lower(trim(nc)) <> lower(trim(oc))
     UNION ALL SELECT id, 'creditor_name_mismatch', NULL FROM p WHERE lower(trim(nr)) <> lower(trim(orr))""",
    "c9_validate": inlined("emails")
    + """, k AS (SELECT id, CASE WHEN part % 6 <> 0 THEN debt_amount END AS a, CASE WHEN part % 5 <> 0 THEN confidence END AS c, intent FROM emails)
     SELECT id, a AS amount, c AS confidence, intent, concat_ws(',', CASE WHEN a IS NULL THEN 'amount' END, CASE WHEN c IS NULL THEN 'confidence' END) AS errors,
       a IS NULL OR c IS NULL AS needs_review FROM k""",
    "c10_checkpoint": inlined("sources")
    + f""", c AS ({_CONSOLIDATED})
     SELECT email_id, CASE weakest WHEN 3 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, email_id % 4 = 0 OR weakest = 1 AS needs_review FROM c""",
    "c14_case_number": inlined("emails") + " SELECT id, CASE WHEN part % 2 = 0 THEN '20/' || order_id ELSE '99-99' END AS case_number FROM emails",
    "c11_merge": inlined("sources", "emails")
    + f""", c AS ({_CONSOLIDATED}), n AS ({_BEST_NAME})
     SELECT e.id AS email_id, coalesce(c.amount, e.debt_amount) AS amount, coalesce(n.client_name, e.client_name) AS client_name,
       (c.amount IS NOT NULL AND NOT coalesce(e.intent IN ('auto_reply', 'spam'), false)) OR coalesce(e.part % 2 = 0, false) AS is_creditor_reply
     FROM c LEFT JOIN n USING (email_id) JOIN emails e ON e.order_id = c.email_id""",
    "c12_match_gate": inlined("emails") + " SELECT id FROM emails WHERE part % 2 = 0 OR reference_number IS NOT NULL",
    "c13_settlement": inlined("emails")
    + """, k AS (SELECT id, confidence, part, supp, CASE supp % 4 WHEN 0 THEN -5.0 WHEN 1 THEN debt_amount END AS o FROM emails),
       w AS (SELECT id, confidence, concat_ws(',', CASE WHEN part % 3 = 0 AND o IS NULL THEN 'counter_offer_without_amount' END, CASE WHEN part % 3 = 1 AND supp % 5 = 0 THEN 'accepted_with_conditional_phrasing' END,
         CASE WHEN o < 0 THEN 'negative_counter_offer' END, CASE WHEN part % 7 <> 0 AND o > 20000 THEN 'counter_offer_exceeds_2x_original' END) AS warnings FROM k)
     SELECT id, warnings, warnings <> '' OR confidence < 0.7 AS needs_review FROM w""",
}
