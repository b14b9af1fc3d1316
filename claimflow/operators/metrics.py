"""Metric rows, daily rollups with retention, call costs, budget, and agreement of two model runs."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.operators.folds import fold_in_order

#: Label names in the order in which they name a group (fixed values).
LABEL_ORDER = ["actor", "queue", "model", "bucket"]


def emit_metrics(emails: DataFrame) -> DataFrame:
    """Long rows (metric_type, metric_value, labels, email_id, recorded_at) of processed mails.

    A mail gives its confidence with a bucket, and one error row if it failed; where ``emails`` has the columns, its
    processing time in milliseconds (``started_at``, ``finished_at``; label actor) and its tokens (``tokens_used``; label
    model from ``model_name``). Null values: no row.
    """
    bucket = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    rows = F.array(
        F.when(F.col("confidence").isNotNull(), F.struct(F.lit("confidence").alias("t"), F.col("confidence").alias("v"), F.create_map(F.lit("bucket"), bucket).alias("l"))),
        F.when(F.col("processing_status") == "failed", F.struct(F.lit("error").alias("t"), F.lit(1.0).alias("v"), F.create_map(F.lit("actor"), F.lit("process_email")).alias("l"))),
    )
    named = lambda t, value, key, label: F.when(value.isNotNull(), F.struct(F.lit(t).alias("t"), value.cast("double").alias("v"), F.create_map(F.lit(key), label).alias("l")))
    more = []
    if {"started_at", "finished_at"} <= set(emails.columns):
        took = (F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))).cast("double")
        more.append(named("processing_time", took, "actor", F.lit("process_email")))
    if "tokens_used" in emails.columns:
        model = F.coalesce("model_name", F.lit("unknown")) if "model_name" in emails.columns else F.lit("unknown")
        more.append(named("tokens", F.col("tokens_used"), "model", model))
    rows = F.concat(rows, F.array(*more)) if more else rows
    found = emails.select("id", "received_at", F.explode(F.array_compact(rows)).alias("m"))
    return found.select(
        F.col("m.t").alias("metric_type"), F.col("m.v").alias("metric_value"), F.to_json("m.l").alias("labels"), F.col("id").alias("email_id"), F.col("received_at").alias("recorded_at")
    )


def queue_depth(emails: DataFrame, at: dt.datetime, waiting: tuple[str, ...] = ("received", "parsed", "processing")) -> DataFrame:
    """One metric row for each waiting status: how many mails received by ``at`` have it (label queue); 0 where none has."""
    statuses = emails.sparkSession.createDataFrame([(s,) for s in waiting], "processing_status string")
    held = emails.where((F.col("received_at") <= F.lit(at)) & F.col("processing_status").isin(*waiting)).groupBy("processing_status").agg(F.count("*").alias("n"))
    depth = statuses.join(held, "processing_status", "left")
    return depth.select(
        F.lit("queue_depth").alias("metric_type"), F.coalesce("n", F.lit(0)).cast("double").alias("metric_value"),
        F.to_json(F.create_map(F.lit("queue"), F.col("processing_status"))).alias("labels"), F.lit(None).cast("long").alias("email_id"), F.lit(at).alias("recorded_at"),
    )


def labels_key(labels: Column) -> Column:
    """``name:value`` of the first known label, else of the first in the text; ``all`` for none."""
    parsed = F.from_json(labels, "map<string,string>")
    known = [F.when(F.map_contains_key(parsed, F.lit(x)), F.concat(F.lit(f"{x}:"), F.element_at(parsed, F.lit(x)))) for x in LABEL_ORDER]
    first = F.try_element_at(F.map_keys(parsed), F.lit(1))
    return F.coalesce(*known, F.concat(first, F.lit(":"), F.try_element_at(F.map_values(parsed), F.lit(1))), F.lit("all"))


def rollup_operational(raw: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Per day, type and label key: count, sum, avg, min, max and exact p95, all dates in one job. Null values don't count.

    p95 is the sorted value at place min(int(0.95 n), n - 1), counted from 0. An approximate percentile, off
    by a rank of n / ``accuracy`` at most, brackets it; only the thousandth of a group inside the bracket
    is ranked, all below it are one count. So no task sorts a hot group.
    """
    keyed = raw.where(F.col("metric_value").isNotNull()).select(
        F.to_date("recorded_at").alias("date"), "metric_type", labels_key(F.col("labels")).alias("labels_key"), "metric_value"
    )
    keys = ["date", "metric_type", "labels_key"]
    margin = 5 / accuracy
    sums = keyed.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.sum("metric_value").alias("sum"),
        F.avg("metric_value").alias("avg"),
        F.min("metric_value").alias("min"),
        F.max("metric_value").alias("max"),
        F.percentile_approx("metric_value", [0.95 - margin, 0.95 + margin], accuracy).alias("bracket"),
    )
    place = F.least(F.floor(F.col("count") * F.lit(0.95)), F.col("count") - 1)
    # a row for each day, type and label: far fewer than raw rows, and Spark broadcasts them where their size allows
    near = keyed.join(sums.select(*keys, place.alias("place"), F.col("bracket")[0].alias("low"), F.col("bracket")[1].alias("high")), keys)
    inside = near.where("metric_value <= high").withColumn("value", F.when(F.col("metric_value") >= F.col("low"), F.col("metric_value")))
    counted = inside.groupBy(*keys, "place", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.col("value").asc_nulls_first()))
    p95 = counted.withColumn("upto", upto).where("upto > place").groupBy(*keys).agg(F.min("value").alias("p95"))
    return sums.drop("bracket").join(p95, keys)


def rollup_prompts(raw: DataFrame) -> DataFrame:
    """Per day and template: calls, token and cost sums, successes, mean confidence, reviews, whole mean milliseconds."""
    return raw.groupBy(F.to_date("extracted_at").alias("date"), "prompt_template_id").agg(
        F.count("*").alias("calls"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.sum(F.coalesce("api_cost_usd", F.lit(0.0))).alias("cost"),
        F.count_if("extraction_success").alias("successes"),
        F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence"),
        F.count_if("manual_review_required").alias("reviews"),
        F.coalesce(F.avg("execution_time_ms"), F.lit(0.0)).cast("int").alias("avg_ms"),
    )


def upsert_daily(daily: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``daily`` with the rows of ``new`` in place of those of the same keys; the same run twice changes nothing."""
    return daily.join(new.select(*keys), keys, "left_anti").unionByName(new)


def apply_retention(raw: DataFrame, today: dt.date, days: int = 30, time_col: str = "recorded_at") -> DataFrame:
    """Rows that aren't older than ``days``; the filter reaches the scan."""
    return raw.where(F.col(time_col) >= F.lit(today - dt.timedelta(days=days)).cast("timestamp"))


def api_cost(calls: DataFrame, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Cost of each call by its model's prices per 1000 tokens; retired names are renamed first, unknown ones take ``default``.

    ``prices`` (model, input_price, output_price) and ``aliases`` (old, new) are tables of settings, a row for each model.
    Without a ``default`` row, calls of unknown models keep a null cost.
    """
    named = calls.join(F.broadcast(aliases), calls["model_name"] == aliases["old"], "left")
    named = named.withColumn("model", F.coalesce("new", "model_name")).drop("old", "new")
    priced = named.join(F.broadcast(prices), "model", "left")
    default = prices.where("model = 'default'").agg(F.max("input_price").alias("din"), F.max("output_price").alias("dout"))
    priced = priced.join(F.broadcast(default))  # an aggregate: one row, of nulls if there is no default
    cost = (
        F.coalesce("input_tokens", F.lit(0)) / 1000 * F.coalesce("input_price", "din")
        + F.coalesce("output_tokens", F.lit(0)) / 1000 * F.coalesce("output_price", "dout")
    )
    return priced.withColumn("cost", cost.cast("decimal(10,6)")).drop("din", "dout", "input_price", "output_price")


def version_stats(raw: DataFrame, now: dt.datetime, days: int = 7) -> DataFrame:
    """Per template in the last ``days``: calls, success rate, mean confidence, whole mean milliseconds, cost."""
    recent = raw.where((F.col("extracted_at") >= F.lit(now - dt.timedelta(days=days))) & (F.col("extracted_at") <= F.lit(now)))
    return recent.groupBy("prompt_template_id").agg(
        F.count("*").alias("calls"),
        F.avg(F.col("extraction_success").cast("double")).alias("success_rate"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.avg("execution_time_ms").cast("int").alias("avg_ms"),
        F.sum("api_cost_usd").alias("cost"),
    )


class _Budget:
    """What a day has spent so far."""

    def __init__(self) -> None:
        self.spent = 0.0

    def accepts(self, cost: float, limit: float) -> bool:
        fits = self.spent + cost <= limit
        self.spent += cost if fits else 0.0
        return fits


def daily_budget_gate(calls: DataFrame, limit: float, time_col: str = "extracted_at", cost_col: str = "api_cost_usd") -> DataFrame:
    """Per UTC day in time order: a call is accepted if spent plus its cost stays within ``limit``; refused ones cost nothing.

    A later, cheaper call may still fit, so a running sum does not do: a day's calls, sorted by Spark, are folded in a stream
    whose memory does not grow with the day. Null cost: 0. Ties: by id.
    """
    slim = calls.select("id", F.col(time_col).alias("at"), F.coalesce(F.col(cost_col), F.lit(0.0)).cast("double").alias("cost"))
    take = lambda day, call: (call.id, call.date, call.cost, day.accepts(call.cost, limit))
    return fold_in_order(slim.withColumn("date", F.to_date("at")), ["date"], ["at", "id"], _Budget, take, "id long, date date, cost double, accepted boolean")


#: Share of equal fields that a call site must reach (fixed values).
AGREEMENT_FLOORS = {"intent": 0.95, "entity": 0.90, "settlement": 0.95}
#: Call sites, their compared fields and how each is compared (fixed values).
AGREEMENT_FIELDS = {
    "intent": {"intent": "equal"},
    "entity": {"is_creditor_reply": "equal", "client_name": "text", "creditor_name": "text", "debt_amount": "amount", "reference_numbers": "set"},
    "settlement": {"counter_offer_amount": "amount"},
}
#: Two amounts are the same within this (fixed value).
SAME_AMOUNT = 0.01


def _agrees(how: str, a: Column, b: Column) -> Column:
    """Whether two answers are the same; two nulls are, a null and a value aren't."""
    if how == "text":
        a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    if how == "set":
        a, b = F.array_sort(a), F.array_sort(b)
    same = a.eqNullSafe(b)
    return same | F.coalesce(F.abs(a.cast("double") - b.cast("double")) <= SAME_AMOUNT, F.lit(False)) if how == "amount" else same


def agreement_report(baseline: DataFrame, candidate: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """Per call site, of two runs over the same inputs: compared fields, equal ones, their rate, errors, invented amounts, and whether the site passes.

    Rows (id, call_site, error) with the fields of ``AGREEMENT_FIELDS``, one row for each id and site. Intents and flags are compared as they are, names trimmed and in lower
    case, references in any order, amounts within a cent; two nulls agree. An error on either side, or a row of one side alone, is an error and compares nothing.
    An amount is invented where only the candidate has a settlement amount; a site with one fails at any rate. Other sites than those three are left out.
    """
    fields = sorted({f for site in AGREEMENT_FIELDS.values() for f in site})
    asked = lambda f: F.col("call_site").isin(*[site for site, shape in AGREEMENT_FIELDS.items() if f in shape])
    row = F.struct("error", *[F.when(asked(f), F.col(f)).alias(f) for f in fields])  # a row is sent with what its site compares
    b, c = (x.where(F.col("call_site").isin(*AGREEMENT_FIELDS)).select("id", "call_site", row.alias(n)) for x, n in ((baseline, "b"), (candidate, "c")))
    both = b.join(c, ["id", "call_site"], "full").withColumn("failed", F.col("b").isNull() | F.col("c").isNull() | F.col("b.error").isNotNull() | F.col("c.error").isNotNull())
    of_site = lambda values: reduce(lambda rest, site: rest.when(F.col("call_site") == site, values[site]), values, F.when(F.lit(False), 0)).otherwise(0)
    equal = {site: sum((_agrees(how, F.col(f"b.{f}"), F.col(f"c.{f}")).cast("int") for f, how in shape.items()), F.lit(0)) for site, shape in AGREEMENT_FIELDS.items()}
    invented = (F.col("call_site") == "settlement") & F.col("b.counter_offer_amount").isNull() & F.col("c.counter_offer_amount").isNotNull()
    done = ~F.col("failed")
    sums = both.groupBy("call_site").agg(
        F.sum(F.when(done, of_site({site: F.lit(len(shape)) for site, shape in AGREEMENT_FIELDS.items()})).otherwise(0)).alias("compared"),
        F.sum(F.when(done, of_site(equal)).otherwise(0)).alias("matches"),
        F.count_if("failed").alias("errors"),
        F.count_if(done & invented).alias("invented"),
    )
    rate = F.when(F.col("compared") > 0, F.col("matches") / F.col("compared")).otherwise(0.0)
    floor = of_site({site: F.lit(x) for site, x in (AGREEMENT_FLOORS | (floors or {})).items() if site in AGREEMENT_FIELDS})
    return sums.withColumn("rate", rate).withColumn("passed", (F.col("rate") >= floor) & (F.col("invented") == 0))
