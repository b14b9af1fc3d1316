"""Tables of cases for single operators, and operators against plain Python on small data."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimflow.functions import names, similarity
from claimflow.functions.amounts import first_amount, parse_amount
from claimflow.operators import confidence, consolidate, extraction, intake, matching, metrics, routing, writeback


def column(spark, values, made, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in frame.select("i", made(F.col("v")).alias("out")).orderBy("i").collect()]


def test_parse_amount(spark):
    cases = {
        "1.234,56 EUR": 1234.56, "2.500 EUR": 2500.0, "234,56 EUR": 234.56, "1,234.56 EUR": 1234.56, "1.234,56 €": 1234.56, "EUR 1.234,56": 1234.56, "1234 EUR": 1234.0,
        "  12,00 Euro ": 12.0, "123.456.789,12 EUR": 123456789.12, "not an amount": None, "": None, "04.12.2024": None, "12.5": 125.0, None: None, "1.234.56": 123456.0,
    }
    assert column(spark, list(cases), parse_amount) == list(cases.values())
    assert column(spark, ["Hauptforderung 1.000 EUR, Zinsen 234,56 EUR", "nichts", "€ 12,50"], first_amount) == [1000.0, None, 12.5]


def test_routing_ids_and_hashes(spark):
    got = column(spark, ["SC-00-1-a3f2-k7p", "SC-A1221-42", "SC-00-3-a3f2-k7p", "SC-00-1-a3f-k7p", "", None], names.parse_routing_id)
    assert got[0]["prefix"] == "SC" and got[0]["letter_type"] == "first" and got[0]["client_hash"] == "a3f2" and got[1:] == [None] * 5
    assert column(spark, ["2025-00042", "4233", "AZ-1221/26", "NE-0001"], names.client_hash) == ["rq1b", "5210", "kri9", "rlwi"]


def test_names(spark):
    got = column(spark, ["Muster, Max", "Max Muster", "Max", "Anna Maria Muster"], names.split_person_name)
    assert [tuple(r) for r in got] == [("Max", "Muster"), ("Max", "Muster"), ("Max", ""), ("Anna", "Maria Muster")]


@pytest.mark.parametrize(
    ("existing", "new", "conf", "reason"),
    [
        (None, None, 0.9, "extraction_returned_none"), (100.0, 50.0, 0.9, "amount_downgrade_prevented"), (None, 50.0, 0.74, "low_extraction_confidence"), (None, 50.0, 0.75, "amount_update_approved"),
        (50.0, 50.0, 0.9, "amount_update_approved"), (None, 500_000.0, 0.9, "amount_update_approved"), (None, 500_000.5, 0.9, "implausible_amount_500000.50_exceeds_500000"),
    ],
)
def test_amount_guard(spark, existing, new, conf, reason):
    frame = spark.createDataFrame([(existing, new, conf)], "e double, n double, c double")
    assert frame.select(confidence.amount_guard(F.col("e"), F.col("n"), F.col("c")).alias("r")).first()["r"] == reason


def test_replay_is_the_sequential_fold(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(4), rng.choice([None, *map(float, range(100, 900, 50)), 9e5]), rng.random(), rng.randrange(50), 200.0) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, k long, new_amount double, confidence double, at long, initial double").repartition(7)
    got = {r["id"]: r["accepted"] for r in confidence.replay_amount_updates(frame, ["k"]).collect()}
    for k in range(4):
        state = 200.0
        for i, _, n, c, _, _ in sorted((r for r in rows if r[1] == k), key=lambda r: (r[4], r[0])):
            ok = n is not None and n <= 500_000 and c >= 0.75 and n >= state
            assert got[i] == ok
            state = n if ok else state


def test_consolidate(spark):
    rows = [(1, 0, "pdf", 200.0, 2, "HIGH"), (1, 1, "image", 500.0, 2, "LOW"), (1, 2, "xlsx", 350.0, 2, "HIGH"), (2, 0, "email_body", 430.0, 2, "MEDIUM"), (2, 1, "email_body", 430.5, 2, "HIGH"), (3, 0, "pdf", 10.0, 1, "HIGH"), (3, 1, "pdf", 99.0, 3, "HIGH"), (4, 0, "pdf", None, None, None)]
    frame = spark.createDataFrame([(*r, None, None, 5) for r in rows], "email_id long, source_idx int, source_type string, amount double, amount_tier int, amount_confidence string, client_name string, client_name_confidence string, tokens_used long")
    got = {r["email_id"]: r for r in consolidate.consolidate(frame).collect()}
    assert [got[i]["amount"] for i in (1, 2, 3, 4)] == [500.0, 430.5, 10.0, None]
    assert got[2]["unique_amounts"] == [430.5] and got[1]["confidence"] == "LOW" and got[4]["method"] == "none" and got[2]["method"] == "regex_fallback"


def test_amount_candidates(spark):
    texts = [(1, "Die Gesamtforderung beträgt 1.234,56 EUR."), (2, "noch zu zahlen: 182,30 EUR"), (3, "Telefon 0761 EUR"), (4, "am 04.12.2024 EUR"), (5, None), (6, ""), (7, "Betrag 50,00 EUR, Summe 20,00 EUR")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["tier"], r["value"], r["confidence"]) for r in extraction.best_amount(extraction.amount_candidates(frame)).collect()}
    assert got == {1: (1, 1234.56, "HIGH"), 2: (1, 182.3, "HIGH"), 7: (1, 20.0, "HIGH")}


def test_validate_german(spark):
    assert column(spark, ["12345", "01234", " 12345 ", "1234", "123456", "1234A", ""], lambda c: extraction.validate_german("postal_code", c)) == [True, True, True, False, False, False, False]
    assert column(spark, ["Müller", "von der Heide", "Meyer-Schmidt", "M3yer", "X"], lambda c: extraction.validate_german("name", c)) == [True, True, True, False, False]
    assert column(spark, ["Hauptstrasse 15", "Am Ring 3a", "Am Ring"], lambda c: extraction.validate_german("address", c)) == [True, True, False]


def test_remove_quotes(spark):
    reply = "Wir stimmen zu. " * 20
    quoted = reply + "\nAm 01.02.2024 um 10:00 schrieb A:\n> alt\n> älter"
    nearly_all = "Ja.\nOn 2024-01-01, A wrote: " + "x " * 300
    got = column(spark, ["kurz > bleibt", quoted, nearly_all], extraction.remove_quotes)
    assert got[0] == "kurz > bleibt" and got[1].strip() == reply.strip() and got[2] == nearly_all


def naive_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_similarity_against_plain_definitions():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(12))) for _ in range(2))
        assert similarity.common_length(a, b) == naive_common(a, b)
    assert similarity.token_sort("max muster", "muster max") == 100.0 and similarity.partial("abc", "xxabcxx") == 100.0
    assert similarity.token_set("max muster", "max muster gmbh") == 100.0 and similarity.name_score("a", "zzzz") == (0.0, "none")
    assert similarity.reference_score(" az-1 ", "AZ-1") == 1.0 and similarity.reference_score("AZ-1", "QQ-99") == 0.0


def inquiry(i, **more):
    row = {"id": i, "client_name": "Max Muster", "creditor_email": f"c{i}@bank.example", "reference_number": f"AZ-{i}", "resend_message_id": f"m{i}", "letter_type": "first", "routing_id": f"SC-A{i}-01", "routing_id_version": "v1", "kanzlei_id": "k", "kanzlei_prefix": "SC", "creditor_idx": 1, "client_hash": "aaaa", "status": "sent", "sent_at": dt.datetime(2024, 1, 1) + dt.timedelta(days=i)}
    return row | more


INQUIRIES = "id long, client_name string, creditor_email string, reference_number string, resend_message_id string, letter_type string, routing_id string, routing_id_version string, kanzlei_id string, kanzlei_prefix string, creditor_idx int, client_hash string, status string, sent_at timestamp"
EMAILS = "id long, to_addresses array<string>, in_reply_to string, subject string, body_text string, body_html string, from_email string, kanzlei_id string"


def route(spark, inquiries, *emails):
    i = spark.createDataFrame(inquiries, INQUIRIES)
    e = spark.createDataFrame([(n, *m) for n, m in enumerate(emails)], EMAILS)
    return {r["id"]: (r["inquiry_id"], r["method"]) for r in routing.route_deterministic(e, i).collect()}


def test_route_cascade(spark):
    v2 = inquiry(5, routing_id="SC-01-2-A3F2-K7P", routing_id_version="v2", client_hash="a3f2", letter_type="second")
    hashed = inquiry(6, routing_id="SC-01-1-RQ1B-ABC", routing_id_version="v2", client_hash="rq1b", reference_number="2025-00042")
    rows = [inquiry(1), inquiry(2), inquiry(3, creditor_email="twice@bank.example"), inquiry(4, creditor_email="twice@bank.example"), v2, hashed]
    none = (None, None, None, None, None, "x@y", None)
    mail = lambda **m: tuple(m.get(k, none[n]) for n, k in enumerate(["to", "ref", "subject", "text", "html", "sender", "tenant"]))
    got = route(
        spark, rows,
        mail(to=["reply-SC-A1-01@reply.example"], ref="<m2>"), mail(to=["a+sc-a2-01@reply.example"]), mail(to=["reply-SC-A1-01@other.example"]), mail(ref=" <m2> "), mail(text="see RAV-SC-A2-01"),
        mail(subject="Re SC-01-2-a3f2-zzz"), mail(subject="2025-00042/SC-01-1"), mail(subject="AZ-2/SC-01"), mail(sender="TWICE@bank.example"), mail(sender="C1@bank.example"), mail(sender="c1@bank.example", tenant="other"),
    )
    assert got == {0: (1, "reply_to"), 1: (2, "reply_to"), 3: (2, "in_reply_to"), 4: (2, "body_rav"), 5: (5, "bare_id"), 6: (6, "combined_ref"), 7: (2, "combined_ref"), 9: (1, "unique_sender")}


def test_candidates_match_brute_force(spark):
    rng = random.Random(2)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    mails = [(i, f"a{rng.randrange(6)}@d{rng.randrange(5)}.example", rng.choice([None, "k1", "k2"]), day(rng.randrange(200))) for i in range(60)] + [(98, "q@q.example", "k1", day(90)), (99, "q@q.example", "k1", day(90) + dt.timedelta(microseconds=1))]
    inqs = [(i, f"a{rng.randrange(6)}@d{rng.randrange(3)}.example", rng.choice(["k1", "k2"]), day(rng.randrange(200))) for i in range(80)] + [(90, "z@z.example", "k1", day(0))]
    e = spark.createDataFrame(mails, "id long, from_email string, kanzlei_id string, received_at timestamp")
    q = spark.createDataFrame(inqs, "id long, creditor_email string, kanzlei_id string, sent_at timestamp")
    want = set()
    for m in mails:
        ok = [(i, 1 if i[1] == m[1] else 2 if i[1].split("@")[1] == m[1].split("@")[1] else 3) for i in inqs if m[3] - dt.timedelta(days=90) <= i[3] <= m[3] and m[2] in (None, i[2])]
        best = min((t for _, t in ok), default=0)
        want |= {(m[0], i[0], t) for i, t in ok if t == best}
    got = [tuple(r) for r in matching.candidates(e, q).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (98, 90, 3) in want and (99, 90, 3) not in want


def test_decide_match_gap(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 10, 0.9, "a@x", at), (1, 11, 0.85, "A@x", at), (1, 12, 0.7, "b@x", at), (2, 20, 0.9, "a@x", at), (2, 21, 0.8, "b@x", at), (3, 30, 0.6, "a@x", at), (4, 40, 0.9, "a@x", at)]
    scored = spark.createDataFrame([(*r, "first") for r in rows], "email_id long, inquiry_id long, score double, creditor_email string, sent_at timestamp, letter_type string")
    mails = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    got = {r["email_id"]: (r["status"], r["inquiry_id"]) for r in matching.decide_match(mails, matching.rank_candidates(scored)).collect()}
    assert got == {1: ("auto_matched", 10), 2: ("ambiguous", None), 3: ("below_threshold", None), 4: ("auto_matched", 40), 5: ("no_recent_inquiry", None)}


@pytest.mark.parametrize("n", [1, 19, 20, 40, 100])
def test_p95_is_the_sorted_place(spark, n):
    values = [float((i * 37) % n) for i in range(n)]
    raw = spark.createDataFrame([("t", v, None, dt.datetime(2024, 1, 1)) for v in values], "metric_type string, metric_value double, labels string, recorded_at timestamp")
    assert metrics.rollup_operational(raw).first()["p95"] == sorted(values)[min(int(n * 0.95), n - 1)]


def test_labels_key(spark):
    cases = {None: "all", "{}": "all", '{"actor":"process_email","stage":"complete"}': "actor:process_email", '{"queue":"q"}': "queue:q", '{"model":"m","operation":"x"}': "model:m", '{"bucket":"high"}': "bucket:high", '{"zz":"1","a":"2"}': "zz:1"}
    assert column(spark, list(cases), metrics.labels_key) == list(cases.values())


def test_budget_gate_lets_a_cheaper_call_in(spark):
    at = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame([(1, at, 6.0), (2, at, 5.0), (3, at, 4.0), (4, at + dt.timedelta(days=1), 9.0), (5, at, None)], "id long, extracted_at timestamp, api_cost_usd double")
    assert {r["id"]: r["accepted"] for r in metrics.daily_budget_gate(frame, 10.0).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_bounces(spark):
    rows = [(1, ["bounce-sc-a1-01@bounce.example"], "Undeliverable", None), (2, ["x@y"], None, "mailbox full"), (3, [], None, None)]
    got = {r["email_id"]: (r["routing_id"], r["kind"]) for r in intake.classify_bounces(spark.createDataFrame(rows, "email_id long, to array<string>, subject string, text string")).collect()}
    assert got == {1: ("SC-A1-01", "hard_bounce"), 2: (None, "soft_bounce"), 3: (None, "unknown_bounce")}


@pytest.mark.parametrize(("a", "b", "fits"), [("x@a.de", "x@a.de", True), ("x@a.de", "y@a.de", True), ("X@A.de", "x@a.DE", True), ("x@a.de", "x@b.de", False), ("x@m.a.de", "y@a.de", False), ("", "x@a.de", False), ("x@gmx.de", "y@gmx.de", False)])
def test_creditor_addresses(spark, a, b, fits):
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    none = F.lit(None).cast("string")
    assert frame.select(writeback.creditor_matches(F.col("a"), none, F.col("b"), [none]).alias("r")).first()["r"] == fits


def test_apply_amounts_leaves_claims(spark):
    element = "struct<id:long,claim_amount:double,current_debt_amount:double,creditor_response_amount:double,amount_source:string,contact_status:string>"
    clients = spark.createDataFrame([(1, [(7, 5.0, None, None, None, None), (8, 6.0, None, None, None, None)]), (2, None)], f"client_id long, final_creditor_list array<{element}>")
    approved = spark.createDataFrame([(1, 1, 1, 10.0), (1, 1, 2, 20.0), (1, 9, 1, 1.0), (None, 0, 1, 1.0)], "client_id long, pos int, at long, amount double")
    got = {r["client_id"]: r["final_creditor_list"] for r in writeback.apply_amounts(clients, approved).collect()}
    assert got[2] is None and [e["claim_amount"] for e in got[1]] == [5.0, 6.0] and [e["current_debt_amount"] for e in got[1]] == [None, 20.0]
