"""Queries over intake and streaming guards, with their SQL."""

from __future__ import annotations


import uuid

from pyspark.sql import functions as F

from claimflow.operators import intake as ops
from claimflow.plans.linkage import SQL as linkage_sql
from claimflow.plans.linkage import routed_emails
from claimflow.sources.adapters import domain, inlined
from claimflow.sources.tables import scratch_dir, written
from claimflow.streaming import intake as streams


def _raw(spark, sf):
    m = domain(spark, sf, "emails")
    none = F.array().cast("array<string>")
    data = F.struct(
        F.concat(F.lit("w"), (F.col("id") % 9000).cast("string")).alias("email_id"), F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.concat(F.lit('"Mr X" <'), "from_email", F.lit(">")).alias("from"), F.array("to_address").alias("to"), F.when(F.col("part") % 2 == 0, F.array(F.lit("cc@x.example"))).alias("cc"), none.alias("bcc"),
        "subject", F.when(F.col("part") % 3 == 0, F.concat(F.lit("m"), F.col("id").cast("string"))).alias("message_id"), F.col("body").alias("text"),
    )
    return m.select(F.to_json(F.struct(F.when(F.col("part") % 10 == 0, "email.sent").otherwise("email.received").alias("type"), data.alias("data"))).alias("value"))


def i1_parse_inbound(spark, sf):
    return ops.parse_inbound(_raw(spark, sf)).select("webhook_id", "message_ref", "from_email", "from_name", F.size("to_addresses").alias("n_to"), "received_at", "processing_status")


def i2_dedup_inbound(spark, sf):
    mails = ops.parse_inbound(_raw(spark, sf))
    stored = domain(spark, sf, "emails").select(F.concat(F.lit("w"), (F.col("id") % 700).cast("string")).alias("webhook_id")).distinct()
    return ops.dedup_inbound(mails, stored).select("webhook_id", "received_at")


def i5_archive(spark, sf):
    s = domain(spark, sf, "sources")
    name = F.when(F.col("source_type") == "pdf", "dir/Brief Nr 1.pdf").when(F.col("source_type") == "image", "..").otherwise(F.concat(F.lit("x_"), "source_type"))
    a = s.select(F.when(F.col("tokens_used") % 2 == 0, "k/1").alias("kanzlei_id"), "email_id", F.col("source_idx").alias("idx"), name.alias("filename"))
    return ops.archive_manifest(a)


def i6_export(spark, sf):
    m = domain(spark, sf, "emails")
    r = m.select("id", F.col("custkey").alias("client_id"), "debt_amount", F.when(F.col("part") % 2 == 0, "manual_review").otherwise("auto_update").alias("route"), F.lit(None).cast("array<string>").alias("reference_numbers"), F.lit(None).cast("string").alias("cleaned_body"), "body")
    out = ops.export_responses(r)
    record = F.from_json("record", "id long, needs_review boolean, reference_numbers array<string>, preview string")
    return out.select(record.alias("r")).select("r.id", "r.needs_review", F.size("r.reference_numbers").alias("n_refs"), "r.preview")


def n3_dedup_inquiries(spark, sf):
    i = domain(spark, sf, "inquiries")
    stored = i.where("id % 2 = 0").select("creditor_email", "letter_type", "resend_email_id", "client_name")
    new = i.withColumn("creditor_email", F.upper("creditor_email")).withColumn("client_name", F.when(F.col("id") % 4 == 0, F.concat(F.lit(" "), "client_name", F.lit(" GmbH"))).otherwise(F.col("client_name")))
    return ops.dedup_inquiries(new, stored).select("id", "creditor_email", "status")


def n6_resolve_tenant(spark, sf):
    return ops.resolve_tenant(routed_emails(spark, sf), domain(spark, sf, "inquiries"))


def c1_intent(spark, sf):
    m = domain(spark, sf, "emails")
    headers = F.when(F.col("part") % 10 == 0, F.create_map(F.lit("auto-submitted"), F.lit("Auto-Replied"))).when(F.col("part") % 10 == 1, F.create_map(F.lit("x-auto-response-suppress"), F.lit("All"))).when(F.col("part") % 10 == 2, F.create_map(F.lit("from"), F.lit("NoReply@x.example")))
    labels = m.where("supp % 4 = 0").select("id", "intent", "confidence")
    return ops.classify_intent(m.select("id", headers.alias("headers"), "subject"), labels)


def c2_headers(spark, sf):
    m = domain(spark, sf, "emails")
    text = F.concat(F.when(F.col("part") % 2 == 0, F.lit("From: ")).otherwise(F.lit("Note: ")), F.col("from_email"), F.lit("\n folded: x\nX-Id: 1\nX-Id: 2\n\nbody: no"))
    h = ops.parse_header_block(text)
    return m.select("id", F.try_element_at(h, F.lit("from")).alias("sender"), F.try_element_at(h, F.lit("x-id")).alias("x_id"), F.size(h).alias("n"))


def _bounces(spark, sf):
    m = domain(spark, sf, "emails")
    text = F.when(F.col("part") % 3 == 0, "550 User unknown, mailbox full").when(F.col("part") % 3 == 1, "Mailbox full").otherwise("?")
    to = F.array(F.lit("x@y.example"), F.concat(F.lit("bounce-"), F.lower("routing_id"), F.lit("@bounce.example")))
    return ops.classify_bounces(m.select(F.col("id").alias("email_id"), to.alias("to"), F.lit("Returned").alias("subject"), text.alias("text"), F.struct("received_at", "id").alias("at")))


def c3_bounces(spark, sf):
    return _bounces(spark, sf).select("email_id", "routing_id", "kind")


def c4_apply_bounces(spark, sf):
    return ops.apply_bounces(domain(spark, sf, "inquiries"), _bounces(spark, sf)).groupBy("status").agg(F.count("*").alias("inquiries"))


def _messages(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    addresses = F.transform(F.sequence(F.lit(0), F.col("user_id") % 12), lambda i: F.concat(F.lit("a"), ((F.col("event_id") * 7 + i) % 40).cast("string")))
    return e.select(F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("domain"), F.col("event_id").alias("id"), (F.col("event_id") * 9000).alias("at_ms"), addresses.alias("addresses"))


def s3_probing_report(spark, sf):
    return streams.probing_report(_messages(spark, sf))


def s2_stream_probing(spark, sf):
    """The same flags from a stream of the same messages."""
    messages = written(_messages(spark, sf).coalesce(1), "messages")
    stream = spark.readStream.schema(messages.schema).parquet(messages.inputFiles()[0].rpartition("/")[0])
    return _drained(streams.stream_probing(stream), "probing")


def s3_over_limit(spark, sf):
    return streams.over_limit(_messages(spark, sf))


def _drained(frame, name):
    """All that a stream gives for the input there is, written to the shared folder and read again."""
    spark = frame.sparkSession
    base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = frame.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{base}/rows")


def _event_stream(spark, sf):
    path = f"{sf}/events.parquet"
    found = spark.read.parquet(path)
    return spark.readStream.schema(found.schema).parquet(path + "*")


def s1_stream_intake(spark, sf):
    e = _event_stream(spark, sf)
    data = F.struct(F.concat(F.lit("w"), F.floor(F.col("event_id") / 2).cast("string")).alias("email_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.lit("a@b.example").alias("from"))
    raw = e.select(F.to_json(F.struct(F.when(F.col("event_type") == "error", "email.sent").otherwise("email.received").alias("type"), data.alias("data"))).alias("value"))
    return _drained(streams.stream_intake(raw, "30 minutes"), "intake").select("webhook_id", "from_email")


def s4_stream_idempotency(spark, sf):
    keys = _event_stream(spark, sf).select(F.concat(F.lit("k"), F.floor(F.col("event_id") / 3).cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return _drained(streams.stream_idempotency(keys), "keys").select("key")


def s1_intake_late(spark, sf):
    """Mails arriving out of order, an id for every other one alone: none that is new is lost."""
    e = _event_stream(spark, sf)
    data = F.struct(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("w"), F.floor(F.col("event_id") / 4).cast("string"))).alias("email_id"), F.date_format(F.expr("ts - make_interval(0, 0, 0, 0, CAST(event_id % 1000 AS INT))"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.lit("a@b.example").alias("from"))
    raw = e.select(F.to_json(F.struct(F.lit("email.received").alias("type"), data.alias("data"))).alias("value"))
    mails = _drained(streams.stream_intake(raw, "1 minute"), "late")
    return mails.groupBy("webhook_id").agg(F.count("*").alias("mails"))


def s5_stream_routing(spark, sf):
    """The batch routing, micro-batch by micro-batch."""
    mails = written(routed_emails(spark, sf), "mails")
    stream = spark.readStream.schema(mails.schema).option("maxFilesPerTrigger", 8).parquet(mails.inputFiles()[0].rpartition("/")[0])
    base = f"{scratch_dir(spark)}/routing-{uuid.uuid4().hex}"
    streams.start_routing(stream, domain(spark, sf, "inquiries"), f"{base}/rows", f"{base}/state", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{base}/rows").drop("batch")


def s6_stream_metrics(spark, sf):
    m = _event_stream(spark, sf).select(F.col("event_type").alias("metric_type"), F.col("value").alias("metric_value"), F.lit('{"queue": "q"}').alias("labels"), F.col("ts").cast("timestamp").alias("recorded_at"))
    return _drained(streams.stream_metrics(m), "metrics").select("date", "metric_type", "labels_key", "count", F.round("sum", 4).alias("sum"), "min", "max")


QUERIES = {f.__name__: f for f in (i1_parse_inbound, i2_dedup_inbound, i5_archive, i6_export, n3_dedup_inquiries, n6_resolve_tenant, c1_intent, c2_headers, c3_bounces, c4_apply_bounces, s1_stream_intake, s1_intake_late, s2_stream_probing, s5_stream_routing, s3_probing_report, s3_over_limit, s4_stream_idempotency, s6_stream_metrics)}

_PARSED = """p AS (SELECT 'w' || (id % 9000) AS webhook_id, CASE WHEN part % 3 = 0 THEN 'm' || id ELSE 'w' || (id % 9000) END AS message_ref, from_email, 'Mr X' AS from_name, 1 + CAST(part % 2 = 0 AS INT) AS n_to, received_at
  FROM emails WHERE part % 10 <> 0)"""
_SCOPE = "upper(split_part({}, '-', 1))"
_EVENTS = "m AS (SELECT user_id % 7 AS d, event_id AS id, event_id * 9000 AS t, list_transform(range(user_id % 12 + 1), lambda i: 'a' || ((event_id * 7 + i) % 40)) AS a FROM events)"

SQL = {
    "i1_parse_inbound": inlined("emails") + f", {_PARSED} SELECT *, 'received' AS processing_status FROM p",
    "i2_dedup_inbound": inlined("emails") + f", {_PARSED} SELECT webhook_id, min(received_at) AS received_at FROM p WHERE webhook_id NOT IN (SELECT 'w' || (id % 700) FROM emails) GROUP BY 1",
    "i5_archive": inlined("sources")
    + """ SELECT email_id, source_idx AS idx, 'attachments/' || CASE WHEN tokens_used % 2 = 0 THEN 'k_1' ELSE '_unassigned' END || '/' || email_id || '/' ||
       CASE source_type WHEN 'pdf' THEN 'Brief_Nr_1.pdf' WHEN 'image' THEN 'attachment_' || source_idx ELSE 'x_' || source_type END AS path FROM sources""",
    "i6_export": inlined("emails") + " SELECT id, part % 2 = 0 AS needs_review, 0 AS n_refs, body AS preview FROM emails",
    "n3_dedup_inquiries": inlined("inquiries")
    + """, k AS (SELECT DISTINCT creditor_email, letter_type, resend_email_id, lower(client_name) AS n FROM inquiries WHERE id % 2 = 0 AND resend_email_id IS NOT NULL)
     SELECT i.id, i.creditor_email, 'sent' AS status FROM inquiries i ANTI JOIN k ON i.creditor_email = k.creditor_email AND i.letter_type = k.letter_type AND i.resend_email_id = k.resend_email_id AND lower(i.client_name) = k.n""",
    "n6_resolve_tenant": inlined("emails", "inquiries")
    + """, o AS (SELECT kanzlei_prefix AS prefix, arg_max(kanzlei_id, (sent_at, id)) AS kanzlei_id FROM inquiries GROUP BY 1),
     p AS (SELECT id, CASE WHEN to_address LIKE 'office+%' OR subject LIKE 'Re: %' OR body LIKE 'See RAV-%' THEN upper(split_part(routing_id, '-', 1)) END AS prefix FROM emails)
     SELECT id, prefix, o.kanzlei_id FROM p LEFT JOIN o USING (prefix)""",
    "c1_intent": inlined("emails")
    + """, k AS (SELECT id, CASE WHEN part % 10 = 0 THEN ('auto_reply', 1.0::DOUBLE, 'header_auto_submitted') WHEN part % 10 = 1 THEN ('auto_reply', 1.0::DOUBLE, 'header_x_auto_response')
         WHEN subject = 'Out of Office' THEN ('auto_reply', 0.95::DOUBLE, 'subject_ooo_pattern') WHEN part % 10 = 2 THEN ('spam', 0.9::DOUBLE, 'noreply_address')
         WHEN supp % 4 = 0 THEN (intent, confidence, 'model') ELSE ('debt_statement', 0.6::DOUBLE, 'fallback') END AS b FROM emails)
     SELECT id, b[1] AS intent, b[2] AS confidence, b[3] AS method, b[1] IN ('auto_reply', 'spam') AS skip_extraction FROM k""",
    "c2_headers": inlined("emails") + " SELECT id, CASE WHEN part % 2 = 0 THEN from_email END AS sender, CASE WHEN part % 2 = 0 THEN '2' END AS x_id, CASE WHEN part % 2 = 0 THEN 2 END AS n FROM emails",
    "c3_bounces": inlined("emails")
    + """ SELECT id AS email_id, CASE WHEN regexp_full_match(upper(routing_id), '[A-Z]{2,3}-[A-Z0-9]+-[0-9]+') THEN upper(routing_id) END AS routing_id,
       CASE part % 3 WHEN 0 THEN 'hard_bounce' WHEN 1 THEN 'soft_bounce' ELSE 'unknown_bounce' END AS kind FROM emails""",
    "c4_apply_bounces": inlined("emails", "inquiries")
    + """, b AS (SELECT upper(routing_id) AS rid, arg_max(CASE part % 3 WHEN 0 THEN 'hard_bounce' WHEN 1 THEN 'soft_bounce' ELSE 'unknown_bounce' END, (received_at, id)) AS kind
       FROM emails WHERE regexp_full_match(upper(routing_id), '[A-Z]{2,3}-[A-Z0-9]+-[0-9]+') GROUP BY 1)
     SELECT coalesce(kind, status) AS status, count(*) AS inquiries FROM inquiries LEFT JOIN b ON upper(routing_id) = rid GROUP BY 1""",
    "s1_stream_intake": "SELECT DISTINCT 'w' || (event_id // 2) AS webhook_id, 'a@b.example' AS from_email FROM events WHERE event_type <> 'error'",
    "s4_stream_idempotency": "SELECT DISTINCT 'k' || (event_id // 3) AS key FROM events",
    "s1_intake_late": "SELECT CASE WHEN event_id % 2 = 0 THEN 'w' || (event_id // 4) END AS webhook_id, count(DISTINCT CASE WHEN event_id % 2 = 1 THEN event_id ELSE 0 END) AS mails FROM events GROUP BY 1",
    "s5_stream_routing": linkage_sql["r_route_deterministic"],
    "s6_stream_metrics": """SELECT CAST(ts AS DATE) AS date, event_type AS metric_type, 'queue:q' AS labels_key, count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events
     WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""",
    "s3_over_limit": f"WITH {_EVENTS} SELECT x.id, len(list_distinct(flatten(list(y.a)))) > 20 AS over FROM m x JOIN m y ON x.d = y.d AND y.t > x.t - 60000 AND y.t <= x.t GROUP BY x.id",
}
