"""SimHash near-dedup: fingerprints of word shingles, linked through pigeonhole blocks, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import NO_ID, ascii_lowered, broadcast_if_small, slices, stored, table, text_hash, without, words_of
from claimflow.llm.jaccard_join import components

BITS, SEED = 64, 42
#: Row v has the bits of the byte v, lowest first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a text, unsigned: a bit is 1 if over half of the shingles' hashes have it; 0 without words.

    Words are runs without ASCII blanks, A-Z lower-cased; shingles of ``size`` words count as often as they stand, a shorter
    text is one shingle. Long texts are taken in slices, so memory doesn't grow with them.
    """
    ones, n, tail = np.zeros(BITS, dtype=np.int64), 0, []
    for part in slices(ascii_lowered(text or "")):
        words = tail + words_of(part)
        if len(words) >= size:
            shingles = map(" ".join, zip(*[words[i:] for i in range(size)], strict=False))
            hashes = np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), SEED) for s in shingles], dtype=np.uint64)
            ones, n = ones + bit_counts(hashes), n + len(hashes)
        tail = words[len(words) - size + 1 :] if len(words) >= size else words
    if not n:
        return xxhash.xxh64_intdigest(" ".join(tail).encode("utf-8", "surrogatepass"), SEED) if tail else 0
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(rows: DataFrame, size: int) -> DataFrame:
    """id, th and the fingerprint (as a signed long) of each row of id, th, text."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(x, size) for x in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": batch["id"], "th": batch["th"], "print": found})

    return rows.mapInPandas(draw, "id long, th long, print long")


def block_masks(radius: int) -> list[int]:
    """Masks of which two fingerprints within ``radius`` bits agree on one at least.

    The bits are cut into ``radius + 2`` blocks; so many differing bits leave two blocks whole, so each pair of blocks is a mask. A
    pair is some 32 bits for a radius of 2: unrelated fingerprints seldom meet, even billions of them.
    """
    parts = radius + 2
    edges = [BITS * i // parts for i in range(parts + 1)]
    single = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(single, 2)]


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_prints(prints: DataFrame, radius: int, most: int) -> DataFrame:
    """Links a, b between distinct fingerprints within ``radius`` bits: all pairs, or enough to connect them.

    Fingerprints meet in a join on the bits under each mask of :func:`block_masks`, then their distance decides. A block that more
    than ``most`` share isn't joined with itself. Its members are linked through common neighbours: two within
    ``radius`` bits have a point half-way, ``radius // 2`` flips from the one and the rest from the other, and
    all that have a point in common are within twice the flips of it. A point has a bounded number of neighbours, so no
    group grows with the data; each is linked to the smallest of them that is within ``radius``.
    """
    masks = [F.struct(F.lit(n).alias("mask"), F.col("print").bitwiseAND(_signed(m)).alias("bits")) for n, m in enumerate(block_masks(radius))]
    keyed = prints.select("print", F.explode(F.array(*masks)).alias("k")).select("print", "k.mask", "k.bits")
    sizes = stored(keyed.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1"), "block-sizes")
    met = stored(keyed.join(sizes, ["mask", "bits"]), "blocks")
    thin = met.where(F.col("n") <= most)
    a, b = (thin.select("mask", "bits", F.col("print").alias(x)) for x in "ab")
    links = a.join(b, ["mask", "bits"]).where((F.col("a") < F.col("b")) & (_distance("a", "b") <= radius)).select("a", "b")

    flips = -(-radius // 2)
    points = [_signed(sum(1 << i for i in chosen)) for k in range(flips + 1) for chosen in combinations(range(BITS), k)]
    crowded = met.where(F.col("n") > most).select("print").distinct()
    beside = crowded.select("print", F.explode(F.transform(F.lit(points).cast("array<bigint>"), lambda x: F.col("print").bitwiseXOR(x))).alias("point"))
    # at most as many as there are points around one: 65 for a radius of 2
    around = beside.groupBy("point").agg(F.collect_list("print").alias("prints")).where(F.size("prints") > 1)
    if radius % 2:
        pairs = around.select(F.explode("prints").alias("a"), "prints").select("a", F.explode("prints").alias("b"))
        return links.union(pairs.where((F.col("a") < F.col("b")) & (_distance("a", "b") <= radius)).distinct())
    hubs = around.select(F.array_min("prints").alias("a"), F.explode("prints").alias("b")).where("a != b")
    return links.union(hubs.distinct())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, most: int = 64) -> DataFrame:
    """Every document with its fingerprint and component: id, th (text hash), print (a signed long), component_id, first.

    Documents link if their SimHash of ``size``-word shingles (:func:`fingerprint`) differ in ``radius`` bits or fewer; component_id is the
    smallest id that links reach, the own one included; ``first`` says whether this id and text hash are the smallest of the
    component. Equal fingerprints are one node, whatever their number, so copies make no pairs. ``most`` is the largest block
    that is joined with itself (:func:`near_prints` has an exact way for the others); it doesn't change the result.

    Null or empty texts and texts of blanks have the fingerprint zero and link like any other. Null id: largest id. Repeated
    rows stay and are in one component. No rows: no rows. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    drawn = stored(fingerprints(rows, size), "prints")
    nodes = stored(drawn.groupBy("print").agg(F.min(F.struct("id", "th")).alias("least"), F.count("*").alias("docs")), "nodes")
    links = near_prints(nodes.select("print"), radius, most)
    labels = components(links).select(F.col("c").alias("print"), "label")
    labelled = nodes.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print"))
    heads = labelled.groupBy("label").agg(F.min("least").alias("head"), F.sum("docs").alias("members")).where("members > 1")
    known = labelled.join(heads, "label").select("print", "head")
    out = drawn.join(known, "print", "left")
    own = F.struct("id", "th")
    return out.select("id", "th", "print", F.coalesce("head.id", "id").alias("component_id"), (F.coalesce("head", own) == own).alias("first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component of :func:`simhash_components`: that of the smallest id and text hash; its repeated rows stay."""
    found = simhash_components(docs, id_col, text_col, **options)
    return without(docs, found.where(~F.col("first")), id_col, text_col)


def op11_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Each document of ``documents`` with its fingerprint and component."""
    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return found.select(real("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), real("component_id").alias("component_id"))
