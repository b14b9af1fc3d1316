"""Review queue, calibration, reports and status lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.operators.consolidate import first_rank

#: Priority of a review reason; others are 5 (fixed values).
PRIORITIES = {"manual_escalation": 1, "validation_failed": 2, "conflict_detected": 3, "extraction_error": 4, "low_confidence": 5, "missing_data": 6, "duplicate_suspected": 7}
STATUSES = ["received", "parsed", "processing", "completed", "failed", "not_creditor_reply"]


def priority_of(reason: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, reason), F.lit(5))


def enqueue_reviews(items: DataFrame, queue: DataFrame, emails: DataFrame) -> DataFrame:
    """Items (email_id, review_reason, at) with outcome: added, skipped (an open one exists, or earlier in the batch), failed (no id, reason or mail)."""
    known = emails.select(F.col("id").alias("email_id")).distinct().withColumn("known", F.lit(True))
    open_ = queue.where("resolved_at IS NULL").select("email_id").distinct().withColumn("open", F.lit(True))
    joined = items.join(known, "email_id", "left").join(open_, "email_id", "left")
    failed = F.col("email_id").isNull() | F.col("review_reason").isNull() | F.col("known").isNull()
    marked = joined.withColumn("outcome", F.when(failed, "failed").when(F.col("open"), "skipped"))
    fresh = marked.where("outcome IS NULL")
    first = first_rank(fresh, ["email_id"], [F.col("at"), F.col("review_reason")]).select("email_id", "at", "review_reason", F.lit(True).alias("first"))
    settled = fresh.join(first, ["email_id", "at", "review_reason"], "left").withColumn("outcome", F.when(F.col("first"), "added").otherwise("skipped")).drop("first")
    every = marked.where("outcome IS NOT NULL").unionByName(settled.select(marked.columns))
    return every.withColumn("priority", priority_of(F.col("review_reason"))).drop("known", "open")


def low_confidence_items(emails: DataFrame, now: dt.datetime, threshold: float = 0.7, hours: int = 24) -> DataFrame:
    """Completed mails of the window one of whose checkpoints (a map stage -> struct(confidence, needs_review)) is weak: id, stage, confidence."""
    recent = emails.where((F.col("processing_status") == "completed") & (F.col("received_at") >= F.lit(now - dt.timedelta(hours=hours))) & (F.col("received_at") <= F.lit(now)))
    stages = recent.select("id", F.explode("checkpoints").alias("stage", "c"))
    scored = stages.withColumn("confidence", F.coalesce("c.confidence", F.lit(1.0)))
    sums = scored.groupBy("id").agg(F.min(F.struct("confidence", "stage")).alias("w"), F.bool_or(F.coalesce("c.needs_review", F.lit(False))).alias("asked"))
    return sums.where(F.col("asked") | (F.col("w.confidence") < threshold)).select("id", "w.stage", "w.confidence")


def pending_reviews(queue: DataFrame, limit: int = 50, reason: str | None = None, claimed: bool | None = None, priorities: tuple[int, int] | None = None) -> DataFrame:
    """The first ``limit`` open items by priority, age and id."""
    found = queue.where("resolved_at IS NULL")
    if reason is not None:
        found = found.where(F.col("review_reason") == reason)
    if claimed is not None:
        found = found.where(F.col("claimed_at").isNotNull() == F.lit(claimed))
    if priorities is not None:
        found = found.where(F.col("priority").between(*priorities))
    return found.orderBy("priority", "created_at", "id").limit(limit)


def queue_stats(queue: DataFrame) -> DataFrame:
    """Open, claimed and resolved items by reason, by priority and in all, as grouping sets: review_reason, priority, counts."""
    flags = queue.select("review_reason", "priority", F.col("resolved_at").isNotNull().alias("r"), F.col("claimed_at").isNotNull().alias("c"))
    sets = flags.groupingSets([[flags["review_reason"]], [flags["priority"]], []], flags["review_reason"], flags["priority"])
    return sets.agg(F.count_if(~F.col("r") & ~F.col("c")).alias("pending"), F.count_if(~F.col("r") & F.col("c")).alias("claimed"), F.count_if("r").alias("resolved"))


def calibration_samples(resolved: DataFrame) -> DataFrame:
    """Approved or corrected reviews with whether the prediction was right, what was corrected, and the confidence bucket.

    ``resolved`` has email_id, resolution, confidence, document_type and for each of amount, client_name, creditor_name: x and corrected_x.
    """
    fields = ["amount", "client_name", "creditor_name"]
    changed = F.array_compact(F.array(*[F.when(F.col(f"corrected_{x}").isNotNull() & ~F.col(f"corrected_{x}").eqNullSafe(F.col(x)), F.lit(f"{x}_corrected")) for x in fields]))
    kind = F.when(F.size(changed) == 0, "none").when(F.size(changed) == 1, F.get(changed, F.lit(0))).otherwise("multiple")
    confidence = F.coalesce("confidence", F.lit(0.5))
    bucket = F.when(confidence >= 0.85, "high").when(confidence >= 0.60, "medium").otherwise("low")
    right = F.col("resolution") == "approved"
    usable = resolved.where(F.col("resolution").isin("approved", "corrected"))
    return usable.select("email_id", right.alias("was_correct"), F.when(~right, kind).alias("correction_type"), bucket.alias("bucket"), "document_type")


def calibration_summary(samples: DataFrame) -> DataFrame:
    """Samples and accuracy by bucket and document type, with subtotals."""
    return samples.rollup("bucket", "document_type").agg(F.count("*").alias("samples"), F.avg(F.col("was_correct").cast("double")).alias("accuracy"))


def processing_reports(emails: DataFrame) -> DataFrame:
    """One report per mail, the last wins: extracted fields, missing ones of four, needs_review below 0.7 or with missing fields."""
    fields = {"client_name": "client_name", "creditor_name": "creditor_name", "debt_amount": "debt_amount", "reference_numbers": "reference_number"}
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for n, c in fields.items()]))
    confidence = F.coalesce("confidence", F.lit(0.5))
    latest = first_rank(emails, ["id"], [F.col("received_at").desc()])
    return latest.select("id", "received_at", confidence.alias("confidence"), missing.alias("missing_fields"), "intent", ((F.size(missing) > 0) | (confidence < 0.7)).alias("needs_review"))


def reports_by_range(reports: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Reports in [start, end), newest first."""
    return reports.where((F.col("received_at") >= F.lit(start)) & (F.col("received_at") < F.lit(end))).orderBy(F.col("received_at").desc(), "id")


def reports_needing_review(reports: DataFrame, limit: int = 100) -> DataFrame:
    return reports.where("needs_review").orderBy(F.col("received_at").desc(), "id").limit(limit)


def job_status(emails: DataFrame) -> DataFrame:
    """Mails per status of the fixed list, zeros included."""
    names = emails.sparkSession.createDataFrame([(s,) for s in STATUSES], "processing_status string")
    counts = emails.groupBy("processing_status").agg(F.count("*").alias("n"))
    return names.join(counts, "processing_status", "left").select("processing_status", F.coalesce("n", F.lit(0)).alias("mails"))


def newest_jobs(emails: DataFrame, limit: int = 20) -> DataFrame:
    """The newest mails with their subject cut to 97 characters and an ellipsis."""
    subject = F.when(F.length("subject") > 100, F.concat(F.left("subject", F.lit(97)), F.lit("..."))).otherwise(F.col("subject"))
    return emails.orderBy(F.col("received_at").desc(), "id").limit(limit).select("id", "received_at", subject.alias("subject"), "processing_status")


def select_reprocess(emails: DataFrame, since: dt.datetime, not_replies: bool = False) -> DataFrame:
    """Failed mails, and those that were no replies if asked, since a date, oldest first, reset for another try."""
    wanted = ["failed", "not_creditor_reply"] if not_replies else ["failed"]
    found = emails.where(F.col("processing_status").isin(wanted) & (F.col("received_at") >= F.lit(since)))
    reset = found.withColumns({"processing_status": F.lit("received"), "retry_count": F.coalesce("retry_count", F.lit(0)) + 1})
    return reset.orderBy("received_at", "id")


def recent_inquiries(inquiries: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    return inquiries.orderBy(F.col("sent_at").desc(), "id").offset(skip).limit(limit)


def sample_for_eval(emails: DataFrame, now: dt.datetime, days: int = 60, limit: int = 100) -> DataFrame:
    """The newest replies of the period as evaluation rows."""
    recent = emails.where((F.col("received_at") >= F.lit(now - dt.timedelta(days=days))) & (F.col("received_at") <= F.lit(now)))
    return recent.orderBy(F.col("received_at").desc(), "id").limit(limit).select("id", "subject", "body", "from_email")
