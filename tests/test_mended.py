"""Prices without a default, metrics of every kind, all name fields of creditors, audit actions, explanations, hot domains."""

import datetime as dt
import json

from pyspark.sql import functions as F

from claimflow.operators import extraction, intake, matching, metrics, writeback
from claimflow.plans import texts
from claimflow.sources import tables

T = dt.datetime(2024, 1, 10)


def test_api_cost_keeps_calls_without_a_default_price(spark):
    calls = spark.createDataFrame([(1, "a", 1000, 1000), (2, "new", 1000, 0), (3, "old", None, 1000)], "id int, model_name string, input_tokens int, output_tokens int")
    prices = spark.createDataFrame([("a", 1.0, 2.0)], "model string, input_price double, output_price double")
    aliases = spark.createDataFrame([("old", "a")], "old string, new string")
    got = {r["id"]: r["cost"] for r in metrics.api_cost(calls, prices, aliases).collect()}
    assert float(got[1]) == 3.0 and got[2] is None and float(got[3]) == 2.0
    twice = prices.unionByName(spark.createDataFrame([("default", 5.0, 5.0)] * 2, prices.schema))
    assert {r["id"]: float(r["cost"]) for r in metrics.api_cost(calls, twice, aliases).collect()} == {1: 3.0, 2: 5.0, 3: 2.0}


def test_metrics_of_every_kind(spark):
    mails = spark.createDataFrame(
        [(1, 0.9, "completed", T, T, T + dt.timedelta(seconds=2), 120, "m"), (2, None, "failed", T, None, None, None, None), (3, None, "parsed", T, None, None, None, None)],
        "id long, confidence double, processing_status string, received_at timestamp, started_at timestamp, finished_at timestamp, tokens_used long, model_name string",
    )
    got = {(r["email_id"], r["metric_type"]): (r["metric_value"], json.loads(r["labels"])) for r in metrics.emit_metrics(mails).collect()}
    assert got == {
        (1, "confidence"): (0.9, {"bucket": "high"}), (2, "error"): (1.0, {"actor": "process_email"}),
        (1, "processing_time"): (2000.0, {"actor": "process_email"}), (1, "tokens"): (120.0, {"model": "m"}),
    }
    depth = {json.loads(r["labels"])["queue"]: r["metric_value"] for r in metrics.queue_depth(mails, T).collect()}
    assert depth == {"received": 0.0, "parsed": 1.0, "processing": 0.0}


def test_find_creditor_by_every_name_field_and_provider(spark):
    mails = spark.createDataFrame(
        [(1, 7, None, "Musterbank Inkasso", None), (2, 7, "a@arcor.de", None, None), (3, 7, "x@firma.example", None, None)],
        "id long, client_id long, from_email string, creditor_name string, position int",
    )
    entries = spark.createDataFrame(
        [(7, 0, "b@arcor.de", "Anders", None, None), (7, 1, "y@firma.example", None, None, None), (7, 2, None, "Nichts", "Die Musterbank", None)],
        "client_id long, pos int, sender_email string, sender_name string, glaeubiger_name string, actual_creditor string",
    )
    got = {r["id"]: r["pos"] for r in writeback.find_creditor(mails, entries).collect()}
    assert got == {1: 2, 3: 1}
    assert not writeback.find_creditor(mails, entries, name_fields=("sender_name",)).where("id = 1").count()


def test_audit_actions_keeps_ten_of_each(spark):
    issues = spark.range(25).select("id", F.lit("stalled").alias("issue"), F.when(F.col("id") < 15, "reprocess").otherwise("resync").alias("action"))
    got = writeback.audit_actions(issues).groupBy("action", "mails").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()
    assert {(r["action"], r["mails"], r["n"], r["low"]) for r in got} == {("reprocess", 15, 10, 0), ("resync", 10, 10, 15)}


def test_explanation_has_signals_and_thresholds(spark):
    ranked = spark.createDataFrame(
        [(1, 11, 1, 0.9, "a@x", "first", T, 0.9, 0.9, 0.4, 0.6), (1, 12, 2, 0.3, "b@x", "first", T, 0.3, 0.3, 0.4, 0.6)],
        "email_id long, inquiry_id long, rank int, score double, creditor_email string, letter_type string, sent_at timestamp, name_score double, reference_score double, name_weight double, reference_weight double",
    )
    mails = spark.createDataFrame([(1,), (2,)], "id long")
    decided = matching.decide_match(mails, ranked)
    got = {r["email_id"]: json.loads(r["explanation"]) for r in matching.explain(decided).collect()}
    signals = got[1]["candidates"][0]["signals"]
    assert abs(signals["client_name"]["weighted"] - 0.36) < 1e-9 and signals["reference_number"]["weight"] == 0.6
    assert got[1]["gap_threshold"] == 0.15 and got[1]["inquiry_id"] == 11 and got[1]["sent_at"].startswith("2024-01-10")
    assert got[2]["match_status"] == "no_recent_inquiry"
    rows = {r["inquiry_id"]: r for r in matching.match_results(decided).collect()}
    assert float(rows[12]["name_score"]) == 0.3 and rows[11]["selected"]


def test_candidates_match_brute_force(spark):
    """All three tiers against every pair: window ends, tenants, nulls, domains without case."""
    day = lambda n: T + dt.timedelta(days=n)
    mails = [(i, a, t, day(100 + 7 * i)) for i, (a, t) in enumerate([("s@a.example", None), ("x@A.example", "k1"), ("free@mail.example", "k1"), ("free@mail.example", None), (None, "k2"), ("s@a.example", "k2")])]
    inquiries = [(100 + i, ["s@a.example", "t@a.example", "u@b.example", None][i % 4], ["k1", "k2", None][i % 3], day(9 * i)) for i in range(24)]
    want = set()
    for m, a, t, at in mails:
        open_ = [(i, b) for i, b, own, sent in inquiries if at - dt.timedelta(days=90) <= sent <= at and (t is None or t == own)]
        domain = lambda x: x.split("@")[1].lower() if x else None
        for number, fits in ((1, lambda b: a and a == b), (2, lambda b: a and b and domain(a) == domain(b)), (3, lambda b: True)):
            if found := [(m, i, number) for i, b in open_ if fits(b)]:
                want |= set(found)
                break
    e = spark.createDataFrame(mails, "id long, from_email string, kanzlei_id string, received_at timestamp")
    q = spark.createDataFrame(inquiries, "id long, creditor_email string, kanzlei_id string, sent_at timestamp")
    got = [tuple(r) for r in matching.candidates(e, q).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = matching.candidates(e, q)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("month" in line and "scope" in line for line in joins)


def test_tables_round_trip(spark, tmp_path):
    """Parquet, JSON and dated output by the readers and writers; fixtures in a JSON array."""
    (tmp_path / "fixtures.json").write_text(json.dumps([{"id": "1", "subject": "s", "body": "b\nb", "from_email": "a@b"}]))
    got = tables.read_eval_fixtures(spark, str(tmp_path / "fixtures.json")).collect()
    assert [(r["id"], r["body"]) for r in got] == [("1", "b\nb")]


def test_t11_keeps_whole_numbers_beyond_five_digits(spark, tmp_path):
    rows = [(99999, "A"), (123456, "B"), (7, "C"), (1234569, "D"), (12, "E")]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["c_custkey"]: r["code_ok"] for r in texts.t11_validate(spark, str(tmp_path)).collect()}
    assert got == {99999: True, 123456: False, 7: False, 1234569: False, 12: True}


def test_creditor_texts_are_prepared_before_the_join(spark):
    """Domains and words are made once a row, not once for each pair of a mail and an entry; the mail's own columns come along."""
    mails = [(1, 7, " A@Big.example ", None, None, 3.0), (2, 7, "x@gmail.com", "Nord Bank", None, 4.0), (3, 7, "q@gmail.com", None, 2, 5.0), (4, 8, "", " ", None, 6.0), (5, 7, "y@gmail.com", None, None, 7.0)]
    lists = [(7, 0, "b@gmail.com", "Ost AG", None), (7, 1, "svc@big.example", "Sparkasse", "Bank Nord GmbH"), (7, 2, None, None, None), (8, 0, "", "", "")]
    mails = spark.createDataFrame(mails, "id long, client_id long, from_email string, creditor_name string, position int, amount double")
    lists = spark.createDataFrame(lists, "client_id long, pos int, sender_email string, sender_name string, creditor_name string")
    found = writeback.find_creditor(mails, lists, carried=("amount",))
    assert sorted(map(tuple, found.collect())) == [(1, 7, 1, 3.0), (2, 7, 1, 4.0), (3, 7, 2, 5.0)]
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any(word in x for x in joins for word in ("regexp", "split", "filter("))


def test_inbound_mails_are_read_once(spark):
    """Mails without an id are new, each of them, an empty id is an id, and one pass over the mails gives both kinds."""
    day = lambda n: dt.datetime(2024, 1, n)
    new = [("a", "m2", day(2)), ("a", "m1", day(1)), ("b", "m", None), ("b", "n", day(3)), (None, "x", day(1)), (None, "x", day(1)), ("", "e", day(4)), ("", "f", day(5)), ("s", "z", day(1)), ("c", "q", day(2)), ("c", "p", day(2))]
    new = spark.createDataFrame(new, "webhook_id string, message_ref string, received_at timestamp")
    stored = spark.createDataFrame([("s",), ("s",), (None,)], "webhook_id string")
    found = intake.dedup_inbound(tables.written(new, "new-mails"), stored)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("a", "m1", day(1)), ("b", "n", day(3)), (None, "x", day(1)), (None, "x", day(1)), ("", "e", day(4)), ("c", "p", day(2))]))
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("Relation" in x and "message_ref" in x for x in plan) == 1


def test_agreement_sends_only_what_a_site_compares(spark):
    """The three sites' rows of one mail don't carry one another's fields; what a site doesn't compare changes nothing."""
    shape = "id long, call_site string, error string, intent string, is_creditor_reply boolean, client_name string, creditor_name string, debt_amount double, reference_numbers array<string>, counter_offer_amount double"
    base = [(1, s, None, "a", True, " X ", None, 5.0, ["r", "q"], None) for s in ("intent", "entity", "settlement")]
    cand = [(1, "intent", None, "a", False, "y", "z", 9.0, [], 3.0), (1, "entity", None, "b", True, "x", None, 5.005, ["q", "r"], 3.0), (1, "settlement", None, "b", False, "y", "z", 9.0, [], None)]
    found = metrics.agreement_report(spark.createDataFrame(base, shape), spark.createDataFrame(cand, shape))
    assert sorted((r["call_site"], r["compared"], r["matches"], r["invented"], r["passed"]) for r in found.collect()) == [("entity", 5, 5, 0, True), ("intent", 1, 1, 0, True), ("settlement", 1, 1, 0, True)]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("client_name, CASE WHEN (call_site") == 2 or text.count("THEN client_name") == 2


def test_german_words_of_texts_with_one_id_stay_apart(spark):
    """Texts are rebuilt in one piece: rows of one id, or of none, are texts of their own; every restored word is restored wherever it stands."""
    rows = [(1, " Gruesse  an\tGruesse, blauer aelter"), (1, "Gruesse"), (None, "schoen"), (None, "x ﬁn schoen"), (2, ""), (3, None), (4, "Blauer Himmel")]
    words = spark.createDataFrame([("Grüsse",), ("schön",), ("grüsse",)], "word string")
    found = extraction.normalize_german(spark.createDataFrame(rows, "doc_id long, text string"), words).collect()
    want = [(1, "Grüsse an Grüsse, blauer aelter"), (1, "Grüsse"), (None, "schön"), (None, "x fin schön"), (2, ""), (4, "Blauer Himmel")]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
