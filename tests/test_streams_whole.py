"""Streams that lose nothing: late first mails, mails without ids, keys that come late; routing like a batch."""

import json

from pyspark.sql import functions as F
from tests.test_streaming import message, run

from claimflow.operators.routing import route_deterministic
from claimflow.streaming import intake as streams


def no_id(at):
    return json.dumps({"type": "email.received", "data": {"created_at": at, "from": "A <a@b.c>", "to": ["x@mu.firm.example"], "subject": "s"}})


def write(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def test_late_and_nameless_mails_stay(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.txt", message("1", "2024-01-02T00:00:00Z"), no_id("2024-01-02T00:00:00Z"), no_id("2024-01-02T00:00:00Z"))
    for n, name in enumerate(("b.txt", "c.txt")):  # far older than what is known, twice each
        write(folder, name, message("2", "2024-01-01T00:00:00Z"), message(f"3{n}", "2023-06-01T00:00:00Z"), no_id("2023-01-01T00:00:00Z"))
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(folder))
    got = sorted(str(r["webhook_id"]) for r in run(streams.stream_intake(raw), tmp_path, "late").collect())
    assert got == sorted(["1", "2", "30", "31", "None", "None", "None", "None"])


def test_intake_keeps_late_mails_and_tenants_of_nameless_ones(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    stored = spark.createDataFrame([("9", "2024-01-01 00:00:00")], "webhook_id string, received_at string").withColumn("received_at", F.to_timestamp("received_at"))
    inquiries = spark.createDataFrame([(1, "k9", "MU", "2024-01-01")], "id long, kanzlei_id string, kanzlei_prefix string, sent_at string")

    def go():
        raw = spark.readStream.format("text").load(str(folder))
        streams.start_intake(raw, stored, inquiries, out, checkpoint, availableNow=True).awaitTermination(120)
        return sorted((str(r["webhook_id"]), str(r["kanzlei_id"])) for r in spark.read.parquet(out).collect())

    write(folder, "a.txt", message("1", "2024-01-02T00:00:00Z"), message("9", "2024-01-02T00:00:00Z"), no_id("2024-01-02T00:00:00Z"), no_id("2024-01-02T00:00:00Z"))
    assert go() == [("1", "None"), ("None", "k9"), ("None", "k9")]
    write(folder, "b.txt", message("1", "2024-01-02T00:00:00Z"), message("5", "2024-01-01T00:00:00Z"), message("6", "2022-01-01T00:00:00Z"), no_id("2022-01-01T00:00:00Z"))
    assert go() == [("1", "None"), ("5", "None"), ("6", "None"), ("None", "k9"), ("None", "k9"), ("None", "k9")]


def test_late_keys_stay(spark, tmp_path):
    schema = "key string, at string"
    for name, rows in (("a", [("x", "2024-05-05"), (None, "2024-05-05")]), ("b", [("y", "2020-01-01"), ("x", "2024-05-05"), (None, "2020-01-01"), ("y", "2020-01-01")])):
        spark.createDataFrame(rows, schema).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "keys"))
    stream = spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "keys"))
    assert sorted(str(r["key"]) for r in run(streams.stream_idempotency(stream), tmp_path, "keys").collect()) == ["None", "None", "x", "y"]


def test_routing_stream_equals_batch(spark, tmp_path):
    inquiries = [(i, f"k{i % 2}", "MU", i % 3, "first", "c001", f"MU-0{i % 3}-1-C001-M2X", "v2", f"AZ-{i}", f"m{i}", f"s{i}@x.example", "sent", f"2024-01-{i + 10}") for i in range(9)]
    inquiries = spark.createDataFrame(inquiries, "id long, kanzlei_id string, kanzlei_prefix string, creditor_idx int, letter_type string, client_hash string, routing_id string, routing_id_version string, reference_number string, resend_message_id string, creditor_email string, status string, sent_at string")
    mails = [(i, ["office@firm.example"], f"<m{i}>" if i % 3 else None, "Re: MU-01-1-C001-M2X" if i % 2 else "s", None, None, f"s{i}@x.example", "k1" if i % 4 else None) for i in range(20)]
    mails = spark.createDataFrame(mails, "id long, to_addresses array<string>, in_reply_to string, subject string, body_text string, body_html string, from_email string, kanzlei_id string")
    mails.repartition(3).write.parquet(str(tmp_path / "mails"))
    stream = spark.readStream.schema(mails.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "mails"))
    streams.start_routing(stream, inquiries, str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination(120)
    rows = lambda f: sorted(map(str, f.drop("batch").collect()))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(route_deterministic(mails, inquiries)) != []


def test_streams_with_state_end(spark, tmp_path):
    """A stream that has read all there is ends, whatever state it holds."""
    rows = spark.createDataFrame([("k", 1, 0, "first")], "key string, id long, at_ms long, result string")
    rows.write.parquet(str(tmp_path / "asked"))
    frame = streams.stream_cached_results(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "asked")))
    query = frame.writeStream.format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "ends")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
