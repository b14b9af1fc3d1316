"""Folds in order against plain Python: the daily budget, probing with hot domains and silences, agreement of two runs."""

import datetime as dt
import random

import pandas as pd

from claimflow.operators import metrics
from claimflow.streaming import intake as streams


def test_budget_equals_a_plain_fold(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=rng.randrange(3 * 1440)), rng.choice([None, 0.5, 1.25, 7.0, 20.0])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, extracted_at timestamp, api_cost_usd double").repartition(5)
    spent, want = {}, {}
    for i, at, cost in sorted(rows, key=lambda r: (r[1], r[0])):
        fits = spent.get(at.date(), 0.0) + (cost or 0.0) <= 100.0
        spent[at.date()] = spent.get(at.date(), 0.0) + ((cost or 0.0) if fits else 0.0)
        want[i] = (at.date(), fits)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # a day spans many batches
    try:
        got = {r["id"]: (r["date"], r["accepted"]) for r in metrics.daily_budget_gate(frame, 100.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and 0 < sum(fits for _, fits in want.values()) < len(want)


def test_budget_of_no_calls(spark):
    assert metrics.daily_budget_gate(spark.createDataFrame([], "id long, extracted_at timestamp, api_cost_usd double"), 1.0).count() == 0


def test_probing_report_split_at_silences(spark):
    rng, rows, at = random.Random(5), [], {}
    for i in range(4000):
        domain = rng.choice(["hot", "hot", "hot", "other", None])
        at[domain] = at.get(domain, 0) + rng.choice([0, 500, 4000, 4000, 30_000, 599_999, 600_000, 900_000])
        rows.append((domain, i, at[domain], [f"a{rng.randrange(30)}" for _ in range(rng.randrange(0, 14))]))
    frame = spark.createDataFrame(rows, "domain string, id long, at_ms long, addresses array<string>").repartition(4)
    probes, want = {}, {}
    for domain, i, when, addresses in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = probes.setdefault(domain, streams.Probe()).step(when, addresses)
    assert {r["id"]: (r["blocked"], r["addresses"]) for r in streams.probing_report(frame).collect()} == want
    assert any(blocked for blocked, _ in want.values())
    stretches = streams._stretches(frame).where("domain = 'hot'").select("stretch").distinct().count()
    assert stretches > 100


def test_agreement_by_field(spark):
    shape = "id long, call_site string, error string, intent string, is_creditor_reply boolean, client_name string, creditor_name string, debt_amount double, reference_numbers array<string>, counter_offer_amount double"
    entity = lambda i, name, amount, refs: (i, "entity", None, None, True, name, None, amount, refs, None)
    offer = lambda i, amount, error=None: (i, "settlement", error, None, None, None, None, None, None, amount)
    intent = lambda i, value: (i, "intent", None, value, None, None, None, None, None, None)
    base = [entity(1, "Max", 10.0, ["a", "b"]), entity(2, None, None, None), offer(1, None), offer(2, 5.0), offer(3, 5.0), intent(1, "rejection"), intent(2, None), intent(9, "x")]
    cand = [entity(1, " MAX ", 10.009, ["b", "a"]), entity(2, "Max", 1.0, []), offer(1, 7.0), offer(2, 5.02), offer(3, 5.0, "timeout"), intent(1, "Rejection"), intent(2, None)]
    found = {r["call_site"]: r for r in metrics.agreement_report(spark.createDataFrame(base, shape), spark.createDataFrame(cand, shape), {"entity": 0.7}).collect()}
    figures = {s: (r["compared"], r["matches"], r["errors"], r["invented"], r["passed"]) for s, r in found.items()}
    assert figures == {"entity": (10, 7, 0, 0, True), "settlement": (2, 0, 1, 1, False), "intent": (2, 1, 1, 0, False)}
    assert metrics.agreement_report(spark.createDataFrame([], shape), spark.createDataFrame([], shape)).count() == 0


def test_ids_of_any_length_and_texts_without(spark):
    from claimflow.operators import routing

    shape = "id long, to_addresses array<string>, in_reply_to string, subject string, body_text string, body_html string, from_email string, kanzlei_id string"
    none = (None, None, None, None, None, None, None)
    texts = ["SC-00012345678901234567890-1-abcd-xyz", "", None, "no id 12/34 at all", "12/sc-007-2 and 9.9/MU-04", "RAV-AB-xy-3"]
    rows = [(i, None, " <> ", t, t, t, None, None) for i, t in enumerate(texts)] + [(9, ["a@b", None, "office+kb-01-2-c001-k7p@reply.example"], *none[1:])]
    got = {(r["id"], r["kind"], r["key"]) for r in routing.email_keys(spark.createDataFrame(rows, shape), r"reply\.example").collect()}
    assert {g for g in got if g[0] == 0} == {(0, "id", "SC-00012345678901234567890-1-ABCD-XYZ"), (0, "parts", "SC|12345678901234567890|1|abcd")}
    assert not {g for g in got if g[0] in (1, 2, 3)}
    assert {g[1:] for g in got if g[0] == 4 and g[1] != "parts"} == {("reference", "SC|7|2|12"), ("old", "MU|04|99")}
    assert {g[1:] for g in got if g[0] == 5} == {("id", "AB-XY-3")}
    assert {g[1:] for g in got if g[0] == 9} == {("id", "KB-01-2-C001-K7P"), ("parts", "KB|1|2|c001")}


def test_probing_holds_a_batch_as_numbers_and_gives_it_in_parts():
    rng = random.Random(8)
    rows = [("d", i, rng.randrange(0, 900_000, 500), [f" A{rng.randrange(40)}" for _ in range(rng.randrange(7))], 5 + i) for i in range(3000)]
    rng.shuffle(rows)
    frame = pd.DataFrame(rows, columns=["domain", "id", "at_ms", "addresses", "arrived_ms"])
    parts = list(streams._fold("d", iter([frame[:1000], frame[1000:1001], frame[1001:]]), streams.Probe(), 700))
    assert parts.pop() == 3004 and [len(p) for p in parts] == [700, 700, 700, 700, 200]
    plain, want = streams.Probe(), []
    for domain, i, at, addresses, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        want.append((domain, i, *plain.step(at, addresses)))
    assert [tuple(r) for p in parts for r in p.itertuples(index=False)] == want
    assert len({w[2] for w in want}) == 2
