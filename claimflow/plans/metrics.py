"""Queries over metrics and costs, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from claimflow.operators import metrics as ops
from claimflow.sources.adapters import domain, inlined

PRICES = [("default", 0.003, 0.015), ("model-a", 0.001, 0.002), ("model-b", 0.002, 0.008)]
_PRICE_ROWS = ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in PRICES)


def rounded(frame, *names, places=6):
    return frame.withColumns({n: F.round(n, places) for n in names})


def a1_emit_metrics(spark, sf):
    return ops.emit_metrics(domain(spark, sf, "emails"))


def a3_rollup_operational(spark, sf):
    return rounded(ops.rollup_operational(domain(spark, sf, "operational_metrics")), "sum", "avg")


def a4_rollup_prompts(spark, sf):
    return rounded(ops.rollup_prompts(domain(spark, sf, "prompt_metrics")), "cost", "avg_confidence")


def a5_upsert_daily(spark, sf):
    raw = domain(spark, sf, "prompt_metrics")
    old = ops.rollup_prompts(raw.where(F.col("id") % 2 == 0)).select("date", "prompt_template_id", "calls")
    new = ops.rollup_prompts(raw.where("extracted_at >= timestamp '2024-01-15'")).select("date", "prompt_template_id", "calls")
    return ops.upsert_daily(old, new, ["date", "prompt_template_id"])


def a6_retention(spark, sf):
    kept = ops.apply_retention(domain(spark, sf, "operational_metrics"), dt.date(2024, 2, 10), 20)
    return kept.groupBy("metric_type").agg(F.count("*").alias("kept"), F.min("id").alias("first_id"))


def a7_api_cost(spark, sf):
    prices = spark.createDataFrame(PRICES, "model string, input_price double, output_price double")
    aliases = spark.createDataFrame([("model-old", "model-b")], "old string, new string")
    costed = ops.api_cost(domain(spark, sf, "prompt_metrics"), prices, aliases)
    return costed.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum(F.col("cost").cast("double")), 3).alias("cost"))


def a8_version_stats(spark, sf):
    found = ops.version_stats(domain(spark, sf, "prompt_metrics"), dt.datetime(2024, 1, 20), 7)
    return rounded(found, "success_rate", "avg_confidence", "cost")


def a9_daily_budget(spark, sf):
    found = ops.daily_budget_gate(domain(spark, sf, "prompt_metrics"), 20.0)
    return found.groupBy("date").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


def a10_agreement(spark, sf):
    """Two runs over all mails at three call sites; the candidate differs from the baseline by rules on ``part``."""
    mails, half = domain(spark, sf, "emails"), F.col("debt_amount").cast("double") / 2
    every = lambda n: F.col("part") % n == 0
    site = F.explode(F.array(*[F.lit(s) for s in ops.AGREEMENT_FIELDS])).alias("call_site")
    refs = lambda *parts: F.array_compact(F.array(*parts)).alias("reference_numbers")
    base = mails.select(
        "id", site, F.lit(None).cast("string").alias("error"), "intent", (F.col("processing_status") != "not_creditor_reply").alias("is_creditor_reply"), "client_name", "creditor_name",
        F.col("debt_amount").cast("double").alias("debt_amount"), refs("reference_number", F.lit("X")), F.when(F.col("intent") == "payment_plan", half).alias("counter_offer_amount"),
    )
    cand = mails.where("part % 40 <> 7").select(
        "id", site, F.when(F.col("part") % 50 == 3, "timeout").alias("error"), F.when(every(25), "spam").otherwise(F.col("intent")).alias("intent"),
        ((F.col("processing_status") != "not_creditor_reply") != every(30)).alias("is_creditor_reply"),
        F.when(every(11), "Someone").when(every(6), F.concat(F.lit("  "), F.upper("client_name"), F.lit(" "))).otherwise(F.col("client_name")).alias("client_name"),
        F.when(every(26), "Guess").otherwise(F.col("creditor_name")).alias("creditor_name"),
        (F.col("debt_amount").cast("double") + F.when(every(9), 1.0).when(every(4), 0.005).otherwise(0.0)).alias("debt_amount"),
        F.when(every(2), refs(F.lit("X"), "reference_number")).otherwise(refs("reference_number", F.lit("X"))).alias("reference_numbers"),
        F.when((F.col("intent") == "rejection") & every(17), 100.0).when((F.col("intent") == "payment_plan") & ~every(19), half).alias("counter_offer_amount"),
    )
    return rounded(ops.agreement_report(base, cand), "rate")


QUERIES = {f.__name__: f for f in (a1_emit_metrics, a3_rollup_operational, a4_rollup_prompts, a5_upsert_daily, a6_retention, a7_api_cost, a8_version_stats, a9_daily_budget, a10_agreement)}

_PROMPT_DAYS = """SELECT CAST(extracted_at AS DATE) AS date, prompt_template_id, count(*) AS calls FROM prompt_metrics"""

SQL = {
    "a1_emit_metrics": inlined("emails")
    + """ SELECT 'confidence' AS metric_type, confidence AS metric_value, '{"bucket":"' || CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END || '"}' AS labels,
       id AS email_id, received_at AS recorded_at FROM emails
     UNION ALL SELECT 'error', 1.0, '{"actor":"process_email"}', id, received_at FROM emails WHERE processing_status = 'failed'""",
    "a3_rollup_operational": inlined("operational_metrics")
    + """, keyed AS (SELECT CAST(recorded_at AS DATE) AS date, metric_type, metric_value AS v,
       CASE WHEN labels IS NULL OR labels = '{}' THEN 'all' WHEN labels->>'actor' IS NOT NULL THEN 'actor:' || (labels->>'actor')
            WHEN labels->>'queue' IS NOT NULL THEN 'queue:' || (labels->>'queue')
            ELSE json_keys(labels)[1] || ':' || (labels->>json_keys(labels)[1]) END AS labels_key FROM operational_metrics)
     SELECT date, metric_type, labels_key, count(*) AS count, round(sum(v), 6) AS sum, round(avg(v), 6) AS avg, min(v) AS min, max(v) AS max,
       list_sort(list(v))[least(CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT), count(*) - 1) + 1] AS p95 FROM keyed GROUP BY 1, 2, 3""",
    "a4_rollup_prompts": inlined("prompt_metrics")
    + """ SELECT CAST(extracted_at AS DATE) AS date, prompt_template_id, count(*) AS calls, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(api_cost_usd), 6) AS cost, count(*) FILTER (extraction_success) AS successes,
       round(coalesce(avg(confidence_score), 0), 6) AS avg_confidence, count(*) FILTER (manual_review_required) AS reviews,
       CAST(trunc(avg(execution_time_ms)) AS INT) AS avg_ms FROM prompt_metrics GROUP BY 1, 2""",
    "a5_upsert_daily": inlined("prompt_metrics")
    + f""", old AS ({_PROMPT_DAYS} WHERE id % 2 = 0 GROUP BY 1, 2), new AS ({_PROMPT_DAYS} WHERE extracted_at >= TIMESTAMP '2024-01-15' GROUP BY 1, 2)
     SELECT * FROM new UNION ALL SELECT * FROM old WHERE (date, prompt_template_id) NOT IN (SELECT (date, prompt_template_id) FROM new)""",
    "a6_retention": inlined("operational_metrics")
    + """ SELECT metric_type, count(*) AS kept, min(id) AS first_id FROM operational_metrics WHERE recorded_at >= TIMESTAMP '2024-01-21' GROUP BY 1""",
    "a7_api_cost": inlined("prompt_metrics")
    + f""", prices(model, i, o) AS (VALUES {_PRICE_ROWS}), named AS (SELECT *, CASE model_name WHEN 'model-old' THEN 'model-b' ELSE model_name END AS model FROM prompt_metrics)
     SELECT model, count(*) AS calls, round(sum(CAST(CAST(coalesce(input_tokens, 0) / 1000.0::DOUBLE * i + output_tokens / 1000.0::DOUBLE * o AS DECIMAL(10,6)) AS DOUBLE)), 3) AS cost
     FROM named JOIN prices USING (model) GROUP BY model""",
    "a8_version_stats": inlined("prompt_metrics")
    + """ SELECT prompt_template_id, count(*) AS calls, round(avg(CAST(extraction_success AS DOUBLE)), 6) AS success_rate, round(avg(confidence_score), 6) AS avg_confidence,
       CAST(trunc(avg(execution_time_ms)) AS INT) AS avg_ms, round(sum(api_cost_usd), 6) AS cost FROM prompt_metrics
     WHERE extracted_at >= TIMESTAMP '2024-01-13' AND extracted_at <= TIMESTAMP '2024-01-20' GROUP BY 1""",
    "a10_agreement": inlined("emails")
    + """, c AS (SELECT *, part % 40 = 7 OR part % 50 = 3 AS failed FROM emails),
     sites AS (
       SELECT 'intent' AS call_site, failed, 1 AS n, CAST(part % 25 <> 0 AS INT) AS same, false AS invented FROM c
       UNION ALL SELECT 'entity', failed, 5, CAST(part % 30 <> 0 AS INT) + CAST(part % 11 <> 0 AS INT) + CAST(part % 26 <> 0 AS INT) + CAST(part % 9 <> 0 AS INT) + 1, false FROM c
       UNION ALL SELECT 'settlement', failed, 1, CAST(NOT (intent = 'rejection' AND part % 17 = 0 OR intent = 'payment_plan' AND part % 19 = 0) AS INT), intent = 'rejection' AND part % 17 = 0 FROM c),
     sums AS (SELECT call_site, CAST(coalesce(sum(n) FILTER (NOT failed), 0) AS BIGINT) AS compared, CAST(coalesce(sum(same) FILTER (NOT failed), 0) AS BIGINT) AS matches,
       count(*) FILTER (failed) AS errors, count(*) FILTER (NOT failed AND invented) AS invented FROM sites GROUP BY 1)
     SELECT * EXCLUDE (call_site), call_site, round(matches / compared, 6) AS rate, matches / compared >= CASE call_site WHEN 'entity' THEN 0.90 ELSE 0.95 END AND invented = 0 AS passed FROM sums""",
}
