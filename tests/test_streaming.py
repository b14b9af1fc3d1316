"""Streams over files, one micro-batch at a time; the probing state machine against its rule."""

import json
import random

from pyspark.sql import functions as F

from claimflow.streaming import intake as streams


def message(i, at, kind="email.received"):
    return json.dumps({"type": kind, "data": {"email_id": i, "created_at": at, "from": "A <a@b.c>", "to": ["x@y.z"], "subject": "s"}})


def run(frame, tmp_path, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_intake_drops_repeats(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join([message("1", "2024-01-01T00:00:00Z"), message("1", "2024-01-01T00:00:05Z"), message("2", "2024-01-01T00:01:00Z"), message("3", "2024-01-01T00:01:00Z", "email.sent"), "broken"]))
    raw = spark.readStream.format("text").load(str(folder))
    got = sorted(r["webhook_id"] for r in run(streams.stream_intake(raw), tmp_path, "intake").collect())
    assert got == ["1", "2"]


def naive(messages):
    seen, blocked, out = {}, 0, {}
    for at, i, addresses in sorted(messages):
        if at < blocked:
            out[i] = True
            continue
        seen = {a: t for a, t in seen.items() if at - t < 60_000}
        seen.update((a.strip().lower(), at) for a in addresses)
        out[i] = len(seen) > 20
        if out[i]:
            seen, blocked = {}, at + 600_000
    return out


def test_probing_batch_and_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"d{i % 3}", i, i * 2000, [f" A{rng.randrange(60)} " for _ in range(rng.randrange(1, 9))]) for i in range(300)]
    frame = spark.createDataFrame(rows, "domain string, id long, at_ms long, addresses array<string>")
    want = {}
    for d in ("d0", "d1", "d2"):
        want |= naive([(at, i, a) for dom, i, at, a in rows if dom == d])
    assert any(want.values())
    assert {r["id"]: r["blocked"] for r in streams.probing_report(frame).collect()} == want
    frame.coalesce(1).write.parquet(str(tmp_path / "probe"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "probe"))
    assert {r["id"]: r["blocked"] for r in run(streams.stream_probing(stream), tmp_path, "probing").collect()} == want


def test_probing_edges():
    probe = streams.Probe()
    assert probe.step(0, [f"a{i}" for i in range(20)]) == (False, 20)
    assert probe.step(60_000, ["b"]) == (False, 1)
    assert probe.step(60_001, [f"c{i}" for i in range(20)])[0]
    assert probe.step(660_000, ["x"])[0] and not probe.step(660_001, ["x"])[0]


def test_metrics_windows(spark, tmp_path):
    rows = spark.range(100).select(F.lit("t").alias("metric_type"), F.col("id").cast("double").alias("metric_value"), F.lit('{"queue":"q"}').alias("labels"), F.timestamp_seconds(F.col("id") * 3600).alias("recorded_at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "m"))
    got = run(streams.stream_metrics(stream), tmp_path, "metrics").orderBy("date").collect()
    assert got[0]["count"] == 24 and got[0]["labels_key"] == "queue:q" and got[0]["max"] == 23.0
