"""Inbound messages and inquiries: parsing, deduplication, tenants, archive paths, exports, headers, intents, bounces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.functions.names import ID_V1, ID_V2, normalize_name, split_person_name
from claimflow.operators.consolidate import first_rank
from claimflow.operators.extraction import nfkc
from claimflow.sources.tables import written

#: Subjects of automatic answers (fixed values).
OUT_OF_OFFICE = [r"abwesenheitsnotiz", r"automatische\s+antwort", r"nicht\s+im\s+büro", r"out\s+of\s+office", r"automatic\s+reply", r"auto-reply", r"ooo:"]
#: Wordings of lasting and passing delivery failures (fixed values).
HARD_BOUNCE = ["user unknown", "mailbox not found", "address rejected", "does not exist", "no such user", "undeliverable", "permanent", "550 ", "551 ", "552 ", "553 ", "554 "]
SOFT_BOUNCE = ["mailbox full", "over quota", "temporarily", "try again", "service unavailable", "421 ", "450 ", "452 "]
INBOUND = (
    "type string, created_at string, data struct<email_id:string,created_at:string,`from`:string,to:array<string>,cc:array<string>,bcc:array<string>,"
    "subject:string,message_id:string,html:string,text:string,attachments:array<struct<id:string,filename:string,content_type:string>>>"
)


def parse_inbound(raw: DataFrame, value_col: str = "value", now: Column | None = None) -> DataFrame:
    """Rows of received mails from JSON texts; other types and broken texts give none.

    ``Name <address>`` becomes name and address; To and CC together are to_addresses; a bad time falls back to ``now``
    (null if not given); the message id, else the mail id, is the reference.
    """
    parsed = raw.select(F.from_json(value_col, INBOUND).alias("m")).where(F.col("m.type") == "email.received").select("m.data.*")
    none = F.array().cast("array<string>")
    named = F.regexp_extract("from", r"^\s*\"?([^\"<]*?)\"?\s*<([^>]+)>\s*$", 1)
    address = F.regexp_extract("from", r"<([^>]+)>", 1)
    at = F.try_to_timestamp("created_at")
    return parsed.select(
        F.col("email_id").alias("webhook_id"),
        F.coalesce("message_id", "email_id").alias("message_ref"),
        F.when(address != "", F.trim(address)).otherwise(F.trim("from")).alias("from_email"),
        F.when(address != "", F.nullif(F.trim(named), F.lit(""))).alias("from_name"),
        "subject", F.col("html").alias("raw_body_html"), F.col("text").alias("raw_body_text"),
        F.concat(F.coalesce("to", none), F.coalesce("cc", none)).alias("to_addresses"),
        F.coalesce("cc", none).alias("cc_addresses"), F.coalesce("bcc", none).alias("bcc_addresses"),
        F.coalesce(at, now if now is not None else F.lit(None).cast("timestamp")).alias("received_at"),
        F.lit("received").alias("processing_status"), "attachments",
    )


def dedup_inbound(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New mails whose webhook id is not stored, one per id, the earliest; a null id is never a duplicate.

    ``new`` is read once: rows without an id get a number of their own, which parts them from each other and from all stored ids.
    """
    known = written(existing.select(F.col("webhook_id").alias("__id"), F.lit(-1).cast("long").alias("__alone")).where("__id IS NOT NULL").distinct(), "known-mails")
    known = F.broadcast(known) if known.limit(1_000_001).count() <= 1_000_000 else known
    alone = F.when(F.col("webhook_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))
    keyed = new.withColumn("__alone", alone).withColumn("__id", F.coalesce("webhook_id", F.lit("")))
    once = first_rank(keyed.join(known, ["__id", "__alone"], "left_anti"), ["__id", "__alone"], [F.col("received_at").asc_nulls_last(), F.col("message_ref")])
    return once.select(*new.columns)


def dedup_inquiries(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New inquiries that no stored one equals in address, letter type, mail id and name, "Last, First" being tried both ways.

    Addresses are lower-cased; status is ``sent``. Rows without a mail id are always new. ``id`` names a new row.
    """
    names = split_person_name(F.col("client_name"))
    turned = F.concat_ws(" ", names["first"], names["last"])
    low = new.withColumn("creditor_email", F.lower("creditor_email")).withColumn("status", F.lit("sent"))
    tries = low.withColumn("__name", F.explode(F.array_distinct(F.array(normalize_name(F.col("client_name"), "inquiry"), normalize_name(turned, "inquiry")))))
    stored = existing.select(F.lower("creditor_email").alias("creditor_email"), "letter_type", "resend_email_id", normalize_name(F.col("client_name"), "inquiry").alias("__name")).distinct()
    known = tries.join(stored, ["creditor_email", "letter_type", "resend_email_id", "__name"], "left_semi").select("id").distinct()
    return low.join(known, "id", "left_anti")


def resolve_tenant(emails: DataFrame, inquiries: DataFrame) -> DataFrame:
    """id, prefix and kanzlei_id of mails by the first hit: recipient's sub-domain or id, then subject, then body; unknown prefixes give null.

    A prefix belongs to the tenant of its newest inquiry. There are as many prefixes as tenants, a small table.
    """
    shape = rf"(?i)\b(?:RAV-)?({ID_V2}|{ID_V1})\b"
    in_text = lambda c: F.nullif(F.upper(F.regexp_extract(F.regexp_extract(F.coalesce(c, F.lit("")), shape, 1), r"^([A-Za-z]{2,3})-", 1)), F.lit(""))
    sub = F.try_element_at(F.filter(F.transform("to_addresses", lambda a: F.upper(F.regexp_extract(a, r"(?i)@([a-z]{2,3})\.[a-z0-9-]+\.[a-z]+$", 1))), lambda x: x != ""), F.lit(1))
    in_to = F.try_element_at(F.filter(F.transform("to_addresses", in_text), lambda x: x.isNotNull()), F.lit(1))
    combined = lambda c: F.nullif(F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)[\w.-]*\d[\w.-]*/([A-Z]{2,3})-\d{2,}", 1)), F.lit(""))
    prefix = F.coalesce(sub, in_to, in_text(F.col("subject")), combined(F.col("subject")), in_text(F.col("body_text")), combined(F.col("body_text")))
    owners = inquiries.where("kanzlei_id IS NOT NULL").groupBy(F.upper("kanzlei_prefix").alias("prefix")).agg(F.max_by("kanzlei_id", F.struct("sent_at", "id")).alias("kanzlei_id"))
    return emails.select("id", prefix.alias("prefix")).join(owners, "prefix", "left").select("id", "prefix", "kanzlei_id")


def archive_manifest(attachments: DataFrame, prefix: str = "attachments") -> DataFrame:
    """email_id, idx and target path ``prefix/tenant/mail/name`` of attachments (kanzlei_id, email_id, idx, filename).

    Names keep ASCII letters, digits, ``.``, ``_`` and ``-``, 200 characters with the extension; empty ones are ``attachment_<idx>``.
    """
    segment = lambda c, empty: F.replace(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(empty)), F.lit("/"), F.lit("_"))
    ascii_ = F.when(F.col("filename").rlike(r"^\p{ASCII}*$"), F.col("filename")).otherwise(F.regexp_replace(nfkc(F.col("filename")), r"[^\p{ASCII}]", ""))
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(ascii_, F.lit("")), r"\\", "/"), "/"), -1)
    safe = F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    extension = F.regexp_extract(safe, r"(\.[A-Za-z0-9]{1,10})$", 1)
    cut = F.when(F.length(safe) > 200, F.concat(F.left(safe, F.lit(200) - F.length(extension)), extension)).otherwise(safe)
    name = F.when(cut == "", F.concat(F.lit("attachment_"), F.col("idx").cast("string"))).otherwise(cut)
    path = F.concat_ws("/", F.lit(prefix), segment(F.col("kanzlei_id"), "_unassigned"), segment(F.col("email_id").cast("string"), "no_email_id"), name)
    return attachments.select("email_id", "idx", path.alias("path"))


def export_responses(results: DataFrame) -> DataFrame:
    """One JSON record per processed mail: keys, amount, route, review flag, references, preview of 500 characters, body.

    A column ``attachments`` (array) comes along if ``results`` has one, an empty array for null.
    """
    answer = [(F.col("route") == "manual_review").alias("needs_review"), F.coalesce("reference_numbers", F.array().cast("array<string>")).alias("reference_numbers")]
    return _records(results, "id", "client_id", "debt_amount", "route", *answer)


def export_settlements(results: DataFrame) -> DataFrame:
    """One JSON record per answer to a settlement: keys, decision, offer, conditions, confidence, review flag, preview, body, attachments as above."""
    return _records(results, F.lit("settlement").alias("kind"), "id", "client_id", "decision", "offer", "conditions", "confidence", "needs_review")


def _records(results: DataFrame, *fields: Column | str) -> DataFrame:
    text = F.coalesce("cleaned_body", "body")
    shown = [F.nullif(F.left(text, F.lit(500)), F.lit("")).alias("preview"), text.alias("body")]
    files = [F.coalesce("attachments", F.array().cast(results.schema["attachments"].dataType)).alias("attachments")] if "attachments" in results.columns else []
    return results.select("id", F.to_json(F.struct(*fields, *shown, *files)).alias("record"))


def parse_header_block(text: Column) -> Column:
    """Map of lower-case header names to values of the lines above the first blank one; null unless a mail header is among them."""
    block = F.split(F.split(text, r"\r?\n\s*\r?\n", 2)[0], r"\r?\n")
    fields = F.filter(block, lambda x: x.rlike(r"^[A-Za-z][A-Za-z0-9-]*:"))
    pairs = F.transform(fields, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    latest = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])))
    return F.when(F.arrays_overlap(names, F.array(*map(F.lit, ["from", "to", "subject", "date"]))), latest)


def classify_intent(emails: DataFrame, labels: DataFrame) -> DataFrame:
    """id, intent, confidence, method, skip_extraction: rules on headers, subject and address, else the model's label, else debt_statement at 0.6.

    ``emails`` has id, headers (map of lower-case names), subject; ``labels`` has id, intent, confidence.
    """
    get = lambda k: F.coalesce(F.try_element_at("headers", F.lit(k)), F.lit(""))
    made = lambda intent, confidence, method: F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    addresses = F.lower(F.concat_ws(" ", get("from"), get("reply-to"), get("sender")))
    rule = (
        F.when(F.contains(F.lower(get("auto-submitted")), F.lit("auto-replied")), made("auto_reply", 1.0, "header_auto_submitted"))
        .when(get("x-auto-response-suppress") != "", made("auto_reply", 1.0, "header_x_auto_response"))
        .when(F.coalesce("subject", F.lit("")).rlike("(?iu)" + "|".join(OUT_OF_OFFICE)), made("auto_reply", 0.95, "subject_ooo_pattern"))
        .when(addresses.rlike("no-?reply@"), made("spam", 0.9, "noreply_address"))
    )
    model = labels.select(F.col("id").alias("__id"), F.when(F.col("intent").isNotNull(), F.struct("intent", "confidence", F.lit("model").alias("method"))).alias("model"))
    joined = emails.select("id", rule.alias("rule")).join(model, F.col("id") == F.col("__id"), "left")
    best = F.coalesce("rule", "model", made("debt_statement", 0.6, "fallback"))
    return joined.select("id", best.alias("b")).select("id", "b.*", F.col("b.intent").isin("auto_reply", "spam").alias("skip_extraction"))


def classify_bounces(bounces: DataFrame, bounce_domains: str = r"bounce\.example") -> DataFrame:
    """``bounces`` (email_id, to, subject, text) with routing_id and kind: hard phrases first, then soft, else unknown."""
    ids = F.transform("to", lambda a: F.upper(F.regexp_extract(a, rf"(?i)bounce-({ID_V1})@(?:{bounce_domains})", 1)))
    text = F.lower(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("text", F.lit(""))))
    holds = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))
    kind = F.when(holds(HARD_BOUNCE), "hard_bounce").when(holds(SOFT_BOUNCE), "soft_bounce").otherwise("unknown_bounce")
    return bounces.withColumn("routing_id", F.try_element_at(F.filter(ids, lambda x: x != ""), F.lit(1))).withColumn("kind", kind)


def apply_bounces(inquiries: DataFrame, classified: DataFrame) -> DataFrame:
    """``inquiries`` with the status of the latest bounce (routing_id, kind, at) of their id."""
    latest = classified.where("routing_id IS NOT NULL").groupBy(F.col("routing_id").alias("__rid")).agg(F.max_by("kind", "at").alias("__kind"))
    joined = inquiries.join(latest, F.upper(inquiries["routing_id"]) == latest["__rid"], "left")
    return joined.withColumn("status", F.coalesce("__kind", "status")).drop("__rid", "__kind")
