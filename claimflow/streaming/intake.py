"""Streams: intake without repeats, idempotency, probing detection, routing, metrics."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from claimflow.operators.folds import fold_in_order
from claimflow.operators.intake import parse_inbound, resolve_tenant
from claimflow.operators.metrics import labels_key
from claimflow.operators.routing import inquiry_keys, route_by_keys
from claimflow.sources.tables import written

WINDOW_MS, BLOCK_MS, MOST_ADDRESSES = 60_000, 600_000, 20


def _once_within(rows: DataFrame, key: str, within: str) -> DataFrame:
    """One row of each key among those that arrive within ``within``; a null key is never a repeat.

    The watermark is on the time of arrival, which only grows, so a first row is kept however old its own times are, and
    state goes ``within`` after the key's first arrival.
    """
    marked = rows.withColumn("__arrived", F.current_timestamp()).withColumn("__alone", F.when(F.col(key).isNull(), F.uuid()))
    return marked.withWatermark("__arrived", within).dropDuplicatesWithinWatermark([key, "__alone"]).drop("__arrived", "__alone")


def stream_intake(raw: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Received mails of a stream of JSON texts, one per webhook id of those that arrive within ``delay``.

    Mails that were received long ago and mails without a webhook id are never dropped.
    """
    return _once_within(parse_inbound(raw), "webhook_id", delay)


def stream_idempotency(keys: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """The first row of each key (columns key, at) of those that arrive within ``ttl``; repeats are dropped, late rows and null keys aren't."""
    return _once_within(keys, "key", ttl)


def start_intake(raw: DataFrame, stored: DataFrame, inquiries: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes", reach_days: int = 30, **trigger):
    """Append the new mails of a stream, with prefix and kanzlei_id, as Parquet under ``path``; returns the running query.

    Repeats that arrive within ``delay`` are dropped by the stream; others by an anti-join against ``stored`` (webhook_id, and received_at if it
    has it) and what earlier batches have written. Written mails lie in folders by the day they were received, and a repeat says
    the same day or one near it, so a batch reads the days from ``reach_days`` before its first mail to as many after its last, not the
    whole store. Mails without webhook id are always new. A batch that is run again replaces itself.
    """
    spark, mails = raw.sparkSession, stream_intake(raw, delay)
    tenanted = StructType([*mails.schema.fields, StructField("prefix", StringType()), StructField("kanzlei_id", StringType())])
    placed = StructType([*tenanted.fields, StructField("day", DateType()), StructField("batch", LongType())])
    spark.createDataFrame([], placed).write.mode("ignore").parquet(path)

    def take(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            ends = batch.agg(F.min("received_at").alias("first"), F.max("received_at").alias("last")).first()
            near = lambda day: (day >= F.date_sub(F.lit(ends["first"]), reach_days)) & (day <= F.date_add(F.lit(ends["last"]), reach_days)) | day.isNull()
            before = spark.read.schema(placed).parquet(path).where(F.col("batch") != number)
            older = stored.where(near(F.to_date("received_at"))) if "received_at" in stored.columns else stored
            if ends["first"] is not None:
                before = before.where(near(F.col("day")))
            known = (older if ends["first"] is not None else stored).select("webhook_id").unionByName(before.select("webhook_id"))
            new = batch.join(known, "webhook_id", "left_anti").withColumn("__row", F.monotonically_increasing_id()).persist()
            asked = new.select(F.col("__row").alias("id"), "to_addresses", "subject", F.col("raw_body_text").alias("body_text"))
            tenants = resolve_tenant(asked, inquiries).withColumnRenamed("id", "__row")
            made = new.join(tenants, "__row", "left").select(*mails.columns, "prefix", F.col("kanzlei_id").cast("string"), F.to_date("received_at").alias("day"), F.lit(number).cast("long").alias("batch"))
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
            new.unpersist()
        finally:
            batch.unpersist()

    return mails.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _arriving(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and arrived_ms, the time of arrival, which is the watermark too.

    State times out by arrival, so no row is late, and a stream that has read all there is ends: only new rows move the watermark.
    """
    arrived = F.current_timestamp()
    return rows.select(*columns, arrived.alias("arrived"), F.unix_millis(arrived).alias("arrived_ms")).withWatermark("arrived", "0 seconds")


def stream_cached_results(requests: DataFrame, ttl_seconds: int = 86_400) -> DataFrame:
    """Rows (key, id, at_ms, result) with the result that holds for them, and whether it is a cached one.

    The first row of a key gives its own result and holds it for ``ttl_seconds``; repeats until then get that one. After it the
    next row is a first one again. The result may be null. A null key is a key of its own.
    """
    ttl = ttl_seconds * 1000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, until = state.get if state.exists else (None, None)
        rows, out = pd.concat(list(batches)), []
        for row in rows.sort_values(["at_ms", "id"]).itertuples():
            cached = until is not None and row.at_ms < until
            if not cached:
                held, until = row.result, int(row.at_ms) + ttl
            out.append((row.key, row.id, held, cached))
        state.update((held, until))
        state.setTimeoutTimestamp(int(rows["arrived_ms"].max()) + ttl)
        yield pd.DataFrame(out, columns=["key", "id", "result", "cached"])

    slim = _arriving(requests, "key", "id", "at_ms", "result")
    return slim.groupBy("key").applyInPandasWithState(update, "key string, id long, result string, cached boolean", "held string, until long", "append", GroupStateTimeout.EventTimeTimeout)


class Probe:
    """Addresses a sender domain has written to lately, and until when it is blocked. Times are milliseconds."""

    def __init__(self, seen: dict[str, int] | None = None, blocked_until: int = 0):
        self.seen, self.blocked_until = dict(seen or {}), blocked_until

    def step(self, at: int, addresses: list[str]) -> tuple[bool, int]:
        """Take one message: whether it is blocked, and the number of addresses in the window. While blocked nothing is recorded."""
        if at < self.blocked_until:
            return True, len(self.seen)
        self.seen = {a: t for a, t in self.seen.items() if at - t < WINDOW_MS}
        for a in addresses:
            self.seen[a.strip().lower()] = at
        count = len(self.seen)
        if count > MOST_ADDRESSES:
            self.blocked_until, self.seen = at + BLOCK_MS, {}
            return True, count
        return False, count


_PROBED = "domain string, id long, blocked boolean, addresses int"


def _fold(domain: str | None, batches: Iterator[pd.DataFrame], probe: Probe, most_rows: int = 10_000) -> Iterator[pd.DataFrame | int]:
    """A domain's messages through the machine in order of time, ``most_rows`` at once; at last the latest time of arrival.

    Until all batches are there a message is held as numbers: its times and id, and 4 bytes an address that names one of the distinct ones.
    """
    known: dict[str, int] = {}
    numbers, codes, sizes, arrived = [], array("i"), array("q", [0]), 0
    for batch in batches:
        numbers.append(batch[["at_ms", "id"]].copy())
        arrived = max(arrived, int(batch["arrived_ms"].max()))
        for addresses in batch["addresses"]:
            codes.extend([known.setdefault(a, len(known)) for a in addresses])
            sizes.append(len(codes))
    rows, spelled = pd.concat(numbers, ignore_index=True), list(known)
    numbers.clear()
    order = rows.sort_values(["at_ms", "id"]).index.to_numpy()
    for start in range(0, len(order), most_rows):
        part = order[start : start + most_rows]
        taken = rows.iloc[part]
        out = [probe.step(int(at), [spelled[c] for c in codes[sizes[i] : sizes[i + 1]]]) for i, at in zip(part.tolist(), taken["at_ms"], strict=True)]
        yield pd.DataFrame({"domain": domain, "id": taken["id"].to_numpy(), "blocked": [b for b, _ in out], "addresses": [n for _, n in out]})
    yield arrived


def _stretches(messages: DataFrame) -> DataFrame:
    """``messages`` with stretch: a domain's messages up to a silence as long as a block, after which its state is empty.

    Two messages of one block-long bucket of time have no such silence between them, so buckets are summed first and the silences
    are found between the sums; no domain's messages are put in order together.
    """
    bucket = F.floor(F.col("at_ms") / BLOCK_MS).alias("bucket")
    sums = messages.groupBy("domain", bucket).agg(F.min("at_ms").alias("first"), F.max("at_ms").alias("last"))
    in_time = Window.partitionBy("domain").orderBy("bucket")
    silent = F.coalesce(F.col("first") - F.lag("last").over(in_time) >= BLOCK_MS, F.lit(True))
    numbered = sums.withColumn("silent", silent).select(F.col("domain").alias("d"), F.col("bucket").alias("b"), F.sum(F.col("silent").cast("long")).over(in_time).alias("stretch"))
    placed = messages.withColumn("bucket", bucket)
    return placed.join(numbered, placed["domain"].eqNullSafe(numbered["d"]) & placed["bucket"].eqNullSafe(numbered["b"])).drop("d", "b", "bucket")


def probing_report(messages: DataFrame) -> DataFrame:
    """Per message (domain, id, at_ms, addresses) of a stored batch: whether its sender domain is blocked, in time order.

    The state machine depends on the order, but its state is empty after a silence as long as a block: a domain is split at all of
    them, and each stretch is folded in a stream of its sorted messages. Only a domain that is never silent is one task's, in bounded memory.
    """

    def take(probe: Probe, row) -> tuple:
        blocked, count = probe.step(int(row.at_ms), list(row.addresses))
        return row.domain, row.id, blocked, count

    slim = _stretches(messages.select("domain", "id", "at_ms", "addresses"))
    return fold_in_order(slim, ["domain", "stretch"], ["at_ms", "id"], Probe, take, _PROBED)


def over_limit(messages: DataFrame) -> DataFrame:
    """Plain flags without blocking: id and whether more than the limit of addresses was seen in the last 60 seconds, built-ins alone."""
    window = Window.partitionBy("domain").orderBy("at_ms").rangeBetween(-(WINDOW_MS - 1), 0)
    seen = F.size(F.array_distinct(F.flatten(F.collect_list(F.transform("addresses", lambda a: F.lower(F.trim(a)))).over(window))))
    return messages.select("id", (seen > MOST_ADDRESSES).alias("over"))


def stream_probing(messages: DataFrame) -> DataFrame:
    """The same on a stream: state per domain, held no longer than a block lasts without messages."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names, times, blocked = state.get if state.exists else ([], [], 0)
        probe = Probe(dict(zip(names, times, strict=True)), blocked)
        for part in _fold(key[0], batches, probe):
            if isinstance(part, int):
                state.update((list(probe.seen), list(probe.seen.values()), probe.blocked_until))
                state.setTimeoutTimestamp(part + BLOCK_MS)
            else:
                yield part

    slim = _arriving(messages, "domain", "id", "at_ms", "addresses")
    return slim.groupBy("domain").applyInPandasWithState(update, _PROBED, "names array<string>, times array<long>, blocked long", "append", GroupStateTimeout.EventTimeTimeout)


def start_routing(emails: DataFrame, inquiries: DataFrame, path: str, checkpoint: str, reply_domains: str = r"reply\.example", **trigger):
    """Route each micro-batch like a batch and append the results as Parquet under ``path``; returns the running query.

    What keys resolve to is summed once, when the stream is started, into a written table that every batch joins; a stream that shall see newer
    inquiries is started again with the same checkpoint.
    """
    keys = written(inquiry_keys(inquiries), "inquiry-keys")

    def route(batch: DataFrame, number: int) -> None:
        routed = route_by_keys(batch, keys, reply_domains)
        routed.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    return emails.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_metrics(metrics: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Daily windows per type and label key; p95 is approximate."""
    keyed = metrics.withWatermark("recorded_at", delay).withColumn("labels_key", labels_key(F.col("labels")))
    sums = keyed.groupBy(F.window("recorded_at", "1 day"), "metric_type", "labels_key").agg(
        F.count("*").alias("count"), F.sum("metric_value").alias("sum"), F.min("metric_value").alias("min"), F.max("metric_value").alias("max"), F.percentile_approx("metric_value", 0.95).alias("p95")
    )
    return sums.select(F.to_date("window.start").alias("date"), "metric_type", "labels_key", "count", "sum", "min", "max", "p95")
