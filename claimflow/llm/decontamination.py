"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

DataFrame operations alone. The windows of an item's size at every place of a text are
fingerprinted, but for those that hold fewer shingles of the benchmark's items of that size than the
similarity takes: their similarity to any item is below it, whatever their fingerprint, so a clean
text costs no fingerprint. Where a window stands relative to the shingles doesn't
matter, so items with parts swapped, words put in or ends cut off have their windows too.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import broadcast_if_small, stored, table, without

BITS = 64
#: Bits of a block of the Hamming index.
BLOCK_BITS = 16


def match_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, n: int, size: int) -> Column:
    """Hashes of ``size`` words from each place on; of all words if they are fewer, none if there are none."""
    count = F.size(words)
    last = F.greatest(count - size, F.lit(0))
    starts = F.when(count > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))


def simhash(frame: DataFrame, keys: list[str], word: str) -> DataFrame:
    """64-bit SimHash of each group's words: a bit is set where most of the words' hashes have it set.

    A sum counts a bit in its lower half and the bit ``BITS // 2`` above it in its upper half.
    """
    h, half = F.xxhash64(word), BITS // 2
    ones = [F.sum(F.shiftrightunsigned(h, b).bitwiseAND((1 << half) + 1)).alias(f"b{b}") for b in range(half)]
    summed = frame.groupBy(*keys).agg(F.count("*").alias("words"), *ones)
    counts = [F.col(f"b{b}").bitwiseAND((1 << half) - 1) for b in range(half)] + [F.shiftrightunsigned(F.col(f"b{b}"), half) for b in range(half)]
    bits = [F.when(2 * n > F.col("words"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for n in counts]
    return summed.select(*keys, reduce(Column.bitwiseOR, [F.shiftleft(x, b) for b, x in enumerate(bits)]).alias("print"))


def blocks(frame: DataFrame) -> DataFrame:
    """A row for each block of ``BLOCK_BITS`` bits of a fingerprint: block number and bits."""
    parts = [F.shiftrightunsigned("print", low).bitwiseAND((1 << BLOCK_BITS) - 1) for low in range(0, BITS, BLOCK_BITS)]
    return frame.select("*", F.posexplode(F.array(*parts)).alias("block", "bits"))


def near_blocks(frame: DataFrame, radius: int) -> DataFrame:
    """:func:`blocks`, each with all bits that differ from it in ``radius // number of blocks`` places at most.

    Of two fingerprints within ``radius`` bits, some block differs by no more than that, so a
    fingerprint's :func:`blocks` meet those of all others within the radius here. With 4 blocks
    and a radius of 15 these are 4 x 697 rows, met by a fingerprint at random in 1 of 23 cases.
    """
    flips = radius * BLOCK_BITS // BITS
    masks = [sum(1 << b for b in chosen) for n in range(flips + 1) for chosen in combinations(range(BLOCK_BITS), n)]
    spread = F.transform(F.lit(masks).cast("array<bigint>"), lambda x: F.col("bits").bitwiseXOR(x))
    return blocks(frame).withColumn("bits", F.explode(spread))


def window_starts(at: Column, n: Column, m: Column, shingle: int, similarity: float) -> Column:
    """Where the windows of ``m`` of the ``n`` words start that hold enough of the shingles at the sorted places ``at``.

    ``similarity`` s of a window of a shingles and an item of b takes (a + b) * s / (1 + s) common ones at least.
    """
    size, width = F.least(m, F.lit(shingle)), F.least(n, m)
    own, item = F.greatest(width - size + 1, F.lit(1)), F.greatest(m - size + 1, F.lit(1))
    need = F.greatest(F.ceil((own + item) * similarity / (1 + similarity) - 1e-6).cast("int"), F.lit(1))
    first = F.sequence(F.lit(0), F.greatest(F.size(at) - need, F.lit(0)))
    low = lambda j: F.greatest(F.get(at, j + need - 1) - own + 1, F.lit(0))
    high = lambda j: F.least(F.get(at, j), n - width)
    none = F.array().cast("array<int>")
    runs = F.transform(first, lambda j: F.when(low(j) <= high(j), F.sequence(low(j), high(j))).otherwise(none))
    return F.when(F.size(at) >= need, F.array_distinct(F.flatten(runs))).otherwise(none)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 15,
) -> DataFrame:
    """Benchmark items that stand in documents: id, th, item_id, start, n_words, similarity.

    A window has as many words as its item, and every place where one can stand is looked at; a text
    shorter than an item is its one window. Windows with too few benchmark shingles to reach
    ``similarity`` (:func:`window_starts`) go; all others are fingerprinted. Their SimHash meets the
    items' of the same length within ``radius`` bits through the blocks of :func:`near_blocks`, which lose no
    such pair, and each pair is checked exactly: the weighted Jaccard
    similarity of the two multisets of ``shingle``-word shingles, weights being
    multiplicities, must be at least ``similarity``. Of the windows of a text that
    hold an item, the most similar, then first, is returned; ``start`` counts words from 0.

    Items of fewer than ``shingle`` words are one shingle, found where all of it stands. Null or empty texts
    and items match nothing. Null ids are kept as ids of their own. ``th`` is the text's
    hash: rows of one id and text are one. No rows on either side: no rows. Other
    columns are ignored. The items' shingles are broadcast only if they are few.
    """
    items = benchmark.select(F.col(item_id_col).alias("item_id"), match_words(F.col(item_text_col)).alias("iwords"))
    items = items.withColumn("m", F.size("iwords")).where("m > 0").dropDuplicates(["item_id", "iwords"])
    items = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "m", "iwords"), "items")
    sizes = sorted(r["n"] for r in items.select(F.least("m", F.lit(shingle)).alias("n")).distinct().collect())

    def grams_of(n: int) -> DataFrame:
        mine = items.where(F.least("m", F.lit(shingle)) == n)
        return mine.select("item", "m", F.posexplode(shingle_hashes(F.col("iwords"), n, n)).alias("q", "gram"))

    item_grams = reduce(DataFrame.unionByName, [grams_of(n) for n in sizes]) if sizes else None
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    if item_grams is None:
        return rows.where(F.lit(False)).select(
            "id", "th", F.lit(None).cast(dict(benchmark.dtypes)[item_id_col]).alias("item_id"),
            F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"),
        )
    item_grams = stored(item_grams, "item-grams")
    looked_up = broadcast_if_small(stored(item_grams.select("m", "gram").distinct(), "sized-grams"))

    words = rows.select("id", "th", match_words(F.col("text")).alias("words"))
    total = F.size("words").alias("n")
    rolled = [words.select("id", "th", total, F.posexplode(shingle_hashes(F.col("words"), n, n)).alias("p", "gram")) for n in sizes]
    hits = reduce(DataFrame.unionByName, rolled).join(looked_up, "gram")
    # a set of places for each text and size: at most the text's words
    places = hits.groupBy("id", "th", "m", "n").agg(F.array_sort(F.collect_set("p")).alias("at"))
    starts = window_starts(F.col("at"), F.col("n"), F.col("m"), shingle, similarity)
    windows = stored(places.select("id", "th", "m", F.explode(starts).alias("start")), "windows")

    wanted = windows.groupBy("id", "th").agg(F.collect_list(F.struct("m", "start")).alias("windows"))
    wanted = wanted.select(F.col("id").alias("wid"), F.col("th").alias("wth"), "windows")
    # words are split once for each text that has windows; a window is a slice of them
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["wid"]) & (rows["th"] == wanted["wth"]))
    texts = stored(texts.select("id", "th", match_words(F.col("text")).alias("words"), "windows").dropDuplicates(["id", "th"]), "words")
    window = F.slice("words", F.col("start") + 1, F.col("m"))
    held = texts.select("id", "th", "words", F.explode("windows").alias("w")).select("id", "th", "words", "w.m", "w.start")
    held = stored(held.select("id", "th", "m", "start", F.xxhash64(window).alias("content")), "held")
    # equal windows, of whatever documents, are fingerprinted and checked once: where the first of them stands
    places = held.groupBy("m", "content").agg(F.min(F.struct("id", "th", "start")).alias("at"))
    places = places.select("m", "content", F.col("at.id").alias("pid"), F.col("at.th").alias("pth"), F.col("at.start").alias("start"))
    distinct = texts.join(places, texts["id"].eqNullSafe(places["pid"]) & (texts["th"] == places["pth"]))
    distinct = stored(distinct.select("m", "content", window.alias("own")), "distinct-windows")

    prints = simhash(distinct.select("m", "content", F.explode("own").alias("word")), ["m", "content"], "word")
    item_prints = simhash(items.select("item", "m", F.explode("iwords").alias("word")), ["item", "m"], "word")
    left = blocks(prints)
    right = near_blocks(item_prints, radius).withColumnRenamed("print", "iprint")
    # a merge, or Spark, which doesn't see how many rows an item spreads to, would broadcast them from the driver
    near = left.join(right.hint("merge"), ["m", "block", "bits"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("iprint"))) <= radius)
    near = near.select("m", "content", "item").distinct()

    n_of = F.least(F.col("m"), F.lit(shingle))
    own_grams = reduce(
        DataFrame.unionByName,
        [distinct.where(n_of == n).select("m", "content", F.explode(shingle_hashes(F.col("own"), n, n)).alias("gram")) for n in sizes],
    )
    own_counts = own_grams.groupBy("m", "content", "gram").agg(F.count("*").alias("a"))
    item_counts = item_grams.groupBy("item", "gram").agg(F.count("*").alias("b"))
    shared = near.join(own_counts, ["m", "content"]).join(item_counts, ["item", "gram"])
    shared = shared.groupBy("m", "content", "item").agg(F.sum(F.least("a", "b")).alias("both"))
    shingles = lambda n: F.greatest(n - shingle + 1, F.lit(1))
    sized = shared.join(distinct.select("m", "content", F.size("own").alias("n")), ["m", "content"])
    union = shingles(F.col("m")) + shingles(F.col("n")) - F.col("both")
    scored = sized.withColumn("similarity", F.col("both") / union).where(F.col("similarity") >= similarity)

    found = held.select("id", "th", "m", "start", "content").join(scored, ["m", "content"]).join(items.select("item", "item_id"), "item")
    best = found.groupBy("id", "th", "item_id").agg(F.min(F.struct(-F.col("similarity"), "start", "m")).alias("best"))
    return best.select("id", "th", "item_id", F.col("best.start").alias("start"), F.col("best.m").alias("n_words"), (-F.col("best.col1")).alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents in which :func:`find_leaks` finds an item of ``benchmark``."""
    return without(docs, find_leaks(docs, benchmark, id_col, text_col, **options), id_col, text_col)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` found in ``documents``; a row for each document and item, clean documents have none."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.min(F.struct(-F.col("similarity"), "start", "n_words")).alias("best"))
    return best.select(
        "doc_id", "item_id", F.col("best.start").alias("start_word"), "best.n_words", F.round(-F.col("best.col1"), 6).alias("similarity")
    )
