"""Client lookup by collation, field rules, settlement review, exports, table input and output, streams with stored state."""

import json

from pyspark.sql import functions as F
from tests.test_streaming import message, run

from claimflow.operators import consolidate, intake, writeback
from claimflow.sources import tables
from claimflow.streaming import intake as streams


def test_client_by_collation(spark):
    clients = spark.createDataFrame([(1, "A/1", "Jörg", "Weiß"), (2, None, "Jorg", "Weiss"), (3, "B_7", "Ab", "Cde"), (4, None, None, "X")], "client_id long, aktenzeichen string, first_name string, last_name string")
    asked = [(1, None, "JO\u0308RG", "WEI\u1e9e"), (2, None, "jorg", "WEISS"), (9, None, "jorg", "weiß"), (3, "B/7", None, None), (4, None, "Abc", "de"), (5, None, " ab ", "CDE"), (6, "A/1", "Ab", "Cde"), (7, None, "Ab", "Cde"), (8, None, None, "X")]
    keys = spark.createDataFrame(asked, "id long, aktenzeichen string, first_name string, last_name string")
    got = {r["id"]: (r["client_id"], r["found_by"]) for r in writeback.find_client(keys, clients).collect()}
    assert got == {1: (1, "name_without_case"), 2: (2, "name_without_case"), 3: (3, "case_number_variant"), 5: (3, "name_without_case"), 6: (1, "case_number"), 7: (3, "name")}


def test_fields_of_any_schema(spark):
    raw = spark.createDataFrame([(1, "5", "2024-01-02", "a"), (2, "11", "soon", "z"), (3, None, None, None), (4, "x", "", "b")], "id long, n string, day string, kind string")
    found = consolidate.validate_partial(raw, {"n": ("int", 0, 10), "day": ("date",), "kind": ("string", ["a", "b"])}).orderBy("id").collect()
    assert [(r["n"], str(r["day"]), r["kind"], r["errors"], r["needs_review"]) for r in found] == [
        (5, "2024-01-02", "a", [], False), (None, "None", None, ["n", "day", "kind"], True), (None, "None", None, [], False), (None, "None", "b", ["n", "day"], True),
    ]


def test_settlement_review(spark):
    rows = [
        (1, "accepted", None, None, 100.0, 0.9), (2, "accepted", None, "In 3 Raten", 100.0, 0.9), (3, "counter_offer", None, None, None, 0.9), (4, "counter_offer", 201.0, None, 100.0, 0.9),
        (5, "counter_offer", -1.0, None, 0.0, 0.9), (6, "no_clear_response", None, None, None, 0.99), (7, "declined", None, None, 5.0, 0.69), (8, "declined", None, None, 5.0, 0.7), (9, None, None, None, None, 0.9), (10, "declined", None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "id long, decision string, offer double, conditions string, debt double, confidence double")
    got = {r["id"]: (r["warnings"], r["needs_review"]) for r in consolidate.settlement_consistency(frame).collect()}
    assert {i for i, (_, review) in got.items() if review} == {2, 3, 4, 5, 6, 7, 9, 10}
    assert [got[i][0] for i in (2, 3, 4, 5)] == [["accepted_with_conditional_phrasing"], ["counter_offer_without_amount"], ["counter_offer_exceeds_2x_original"], ["negative_counter_offer"]]


def test_exports(spark):
    rows = [(1, 7, "accepted", None, "", 0.9, False, None, "x" * 600, ["u/a.pdf"]), (2, 7, "declined", 5.0, None, 0.1, True, "", "raw", None)]
    frame = spark.createDataFrame(rows, "id long, client_id long, decision string, offer double, conditions string, confidence double, needs_review boolean, cleaned_body string, body string, attachments array<string>")
    got = {r["id"]: json.loads(r["record"]) for r in intake.export_settlements(frame).collect()}
    assert got[1]["attachments"] == ["u/a.pdf"] and len(got[1]["preview"]) == 500 and len(got[1]["body"]) == 600
    assert got[2]["attachments"] == [] and "preview" not in got[2] and got[2]["offer"] == 5.0 and got[2]["kind"] == "settlement"
    answers = frame.select("*", F.lit("manual_review").alias("route"), F.lit(1.0).alias("debt_amount"), F.lit(None).cast("array<string>").alias("reference_numbers"))
    got = {r["id"]: json.loads(r["record"]) for r in intake.export_responses(answers).collect()}
    assert got[1]["attachments"] == ["u/a.pdf"] and got[2]["reference_numbers"] == [] and got[2]["needs_review"]
    assert "attachments" not in json.loads(intake.export_responses(answers.drop("attachments")).first()["record"])


def test_tables(spark, tmp_path):
    path = str(tmp_path / "daily")
    day = lambda d, v: spark.createDataFrame([(d, v)], "date string, v long")
    for frame in (day("2024-01-01", 1), day("2024-01-02", 2), day("2024-01-02", 3)):
        tables.write_daily(frame, path)
    assert sorted((str(r["date"]), r["v"]) for r in tables.read_table(spark, path).collect()) == [("2024-01-01", 1), ("2024-01-02", 3)]
    (tmp_path / "replies.json").write_text(json.dumps([{"id": "1", "subject": "s", "body": "b\nc", "from_email": "a@b.c", "more": 1}, {"id": "2"}]))
    assert [tuple(r) for r in tables.read_eval_fixtures(spark, str(tmp_path / "replies.json")).orderBy("id").collect()] == [("1", "s", "b\nc", "a@b.c"), ("2", None, None, None)]


def test_intake_against_stored(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    stored = spark.createDataFrame([("9",)], "webhook_id string")
    inquiries = spark.createDataFrame([("ab", 5, 1, "2024-01-01")], "kanzlei_prefix string, kanzlei_id long, id long, sent_at string")
    raw = spark.readStream.format("text").load(str(folder))

    def go(name, *lines):
        (folder / name).write_text("\n".join(lines))
        streams.start_intake(raw, stored, inquiries, out, str(tmp_path / "ck"), availableNow=True).awaitTermination(120)
        return sorted((r["webhook_id"], r["kanzlei_id"]) for r in spark.read.parquet(out).collect())

    mail = json.loads(message("1", "2024-01-01T00:00:00Z"))
    mail["data"]["to"] = ["x@ab.reply.example"]
    assert go("a.txt", json.dumps(mail), message("9", "2024-01-01T00:00:00Z"), message("2", "2024-01-03T00:00:00Z")) == [("1", "5"), ("2", None)]
    # two days on the stream has forgotten mail 2; what was written has not
    assert go("b.txt", message("2", "2024-01-05T00:00:00Z"), message("3", "2024-01-05T00:00:00Z")) == [("1", "5"), ("2", None), ("3", None)]


def test_cached_results(spark, tmp_path):
    rows = [("k", 1, 0, "first"), ("k", 2, 9_999, "second"), ("k", 3, 10_000, "third"), ("k", 4, 12_000, "fourth"), ("n", 5, 0, None), ("n", 6, 1, "x")]
    frame = spark.createDataFrame(rows, "key string, id long, at_ms long, result string")
    frame.coalesce(1).write.parquet(str(tmp_path / "asked"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "asked"))
    got = {r["id"]: (r["result"], r["cached"]) for r in run(streams.stream_cached_results(stream, 10), tmp_path, "cached").collect()}
    assert got == {1: ("first", False), 2: ("first", True), 3: ("third", False), 4: ("third", True), 5: (None, False), 6: (None, True)}


def test_client_names_meet_the_collation_once(spark):
    clients = spark.createDataFrame([(1, None, "Jörg", "Weiß"), (2, None, "Jorg", "Weiss")], "client_id long, aktenzeichen string, first_name string, last_name string")
    keys = spark.range(60).select("id", F.lit(None).cast("string").alias("aktenzeichen"), F.when(F.col("id") % 2 == 0, "JÖRG").otherwise("jorg").alias("first_name"), F.when(F.col("id") % 2 == 0, "weiß").otherwise("WEISS").alias("last_name"))
    found = writeback.find_client(keys, clients)
    assert {(r["id"] % 2, r["client_id"]) for r in found.collect()} == {(0, 1), (1, 2)} and found.count() == 60
    assert "Aggregate [first_name" in found._jdf.queryExecution().optimizedPlan().toString()
