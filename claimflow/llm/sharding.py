"""Sharding: size-weighted sampled splitters, range partition, exact subdivision of overfull ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.llm.common import NO_ID, stored, table

FIXED_BYTES = 8


def _searcher(bounds: list[tuple[int, int]]):
    """A vectorised lookup of the range of an (id, salt) key among sorted splitters."""
    first = np.array([b[0] for b in bounds], dtype=np.int64)
    second = np.array([b[1] for b in bounds], dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        k, s = key.to_numpy(np.int64), salt.to_numpy(np.int64)
        low, high = np.searchsorted(first, k, "left"), np.searchsorted(first, k, "right")
        out = high.copy()
        for at in np.unique(low[high > low]):  # the key is a splitter itself: the salt decides
            mine = np.flatnonzero((low == at) & (high > low))
            out[mine] = at + np.searchsorted(second[at : high[mine[0]]], s[mine], "right")
        return pd.Series(out, dtype="int32")

    return range_of


def splitters(sized: DataFrame, total: int, ranges: int, sample_size: int) -> list[tuple[int, int]]:
    """Quantile boundaries of a size-weighted sample of keys; ``total`` is the sum of all sizes.

    Each row draws the number -log(u) / size, u from a hash of its key; the ``sample_size`` smallest are a
    weighted sample without replacement that is the same on every run. A draw is below t with
    chance size * t at most, so that of all rows about 2 * ``sample_size`` are below 2 * ``sample_size`` / total: only these
    are sorted, and no more reach the driver, however many partitions there are.
    """
    u = (F.pmod(F.xxhash64("id", "salt", F.lit(7)), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    drawn = sized.select("id", "salt", (-F.log(u) / F.col("size")).alias("draw"), "size")
    low = drawn.where(F.col("draw") < 2.0 * sample_size / max(total, 1))
    keys = sorted((r["id"], r["salt"]) for r in low.orderBy("draw", "id", "salt").limit(sample_size).collect())
    if not keys:
        return []
    picks = {min(len(keys) - 1, len(keys) * i // ranges) for i in range(1, ranges)}
    return sorted({keys[i] for i in picks})


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = 32,
    samples_per_range: int = 16,
    row_bytes: int = FIXED_BYTES,
    range_rows: int = 2_000_000,
) -> DataFrame:
    """Deal rows to ``shards`` ranges of the id of near-equal bytes: id, size, text_crc32, shard, slot.

    Splitters of a size-weighted sample cut the ids into ``shards *
    ranges_per_shard`` fine ranges, or as many as leave each about ``range_rows`` rows; the exact bytes of each are counted, and a
    range that crosses a shard's exact boundary, or is overfull, is subdivided row
    by row by its running bytes. So a shard is off the mean by a row's size at
    most, and each window holds one fine range only. Rows of one id are told
    apart by a salt, so a hot id is split like any other; ``slot`` counts rows
    of a shard from 0 without gaps.

    About ``2 * samples_per_range * ranges`` keys and a count per range reach the driver: some megabytes
    at a hundred billion rows. Null text: size ``row_bytes``, crc32 of ''.
    Null id: largest id. Equal rows may be split between shards; which of
    them goes where is no visible difference. No rows: no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("orig_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.monotonically_increasing_id().alias("salt"),
        (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    slim = stored(slim, "shard-keys")  # the salt is fixed from here on
    whole = slim.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    ranges = max(shards * ranges_per_shard, -(-whole["rows"] // range_rows))
    bounds = splitters(slim, whole["bytes"] or 0, ranges, ranges * samples_per_range)
    placed = slim.withColumn("range", _searcher(bounds)("id", "salt") if bounds else F.lit(0))

    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    sums = sorted((r["range"], r["bytes"], r["rows"]) for r in sums)
    total = sum(b for _, b, _ in sums)
    before, base = 0, []
    for r, b, _ in sums:
        base.append((r, before))
        before += b
    bases = spark.createDataFrame(base, "range int, before long")
    # the middle of each row's bytes decides, so both neighbours of a boundary are equally near; doubled, to stay whole
    running = F.sum("size").over(Window.partitionBy("range").orderBy("id", "salt"))
    middle_x2 = 2 * (F.col("before") + F.col("running")) - F.col("size")
    cut = placed.join(F.broadcast(bases), "range").withColumn("running", running)
    cut = cut.withColumn("scaled", middle_x2 * F.lit(shards))
    shard = F.expr(f"cast(least(scaled div {2 * max(total, 1)}L, {shards - 1}L) AS int)")
    cut = stored(cut.withColumn("shard", shard).drop("before", "running", "scaled"), "shard-cut")

    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy("id", "salt")) - 1
    pieces = cut.groupBy("shard", "range").agg(F.count("*").alias("rows"))
    # at most ranges + shards pieces
    start = F.sum("rows").over(Window.partitionBy("shard").orderBy("range")) - F.col("rows")
    pieces = pieces.select("shard", "range", start.alias("start"))
    out = cut.withColumn("within", within).join(F.broadcast(pieces), ["shard", "range"])
    return out.select(
        F.col("orig_id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot")
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` into shards 0 to 23 under the law ``bytes``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = shard_by_bytes(docs)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
