"""Best-fit packing: a configuration LP over the length histogram, rounded.

The corpus is tokenized once into pieces; only the histogram of piece lengths
(at most ``capacity`` numbers) decides how sequences are composed. The plan, a
list of patterns with multiplicities whose size doesn't depend on the corpus,
is broadcast, and each piece finds its place from its length and its rank among
the pieces of that length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.llm.common import NO_ID, stored, table

CAPACITY = 1024
END_ID = 2
#: How a byte-level pre-tokenizer with its own pattern splits text (a fixed value of that file format).
PRE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked_bytes(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file as bytes -> id; None unless merges rank as ids do."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"].get(m) for m in merged]
    if None in ids or ids != sorted(set(ids)):
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


#: A run of blanks this long is left to ``tokenizers``: the faster encoder's regular expression recurses on blanks.
LONG_BLANKS = re.compile(r"\s{4096}")


class Encoder:
    """Token ids of whole texts as little-endian bytes: the ids that ``tokenizers`` gives for the file.

    That is ``encode(text, add_special_tokens=False)``, so an added token that stands in a text is that
    token. Where the file is plain byte-level BPE, a faster encoder is made of its own
    vocabulary and merges for all texts that hold no added token and no overlong run of blanks; those texts, and
    any other file, are left to ``tokenizers``.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.added = [t["content"] for t in json.load(file)["added_tokens"]]
        ranks = ranked_bytes(path)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PRE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @functools.cached_property
    def slow(self):
        """``tokenizers`` itself, read only where a text needs it: it holds much memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        plain = self.fast and not any(t in text for t in self.added) and not (len(text) >= 4096 and LONG_BLANKS.search(text))
        return self.fast(text) if plain else self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes() if text else b""


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(length: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of a document; only the first piece of a cut one may be short."""
    first = length if length <= capacity else length % capacity or capacity
    starts = [0, *range(first, length, capacity)]
    for piece, start in enumerate(starts):
        yield piece, start, (first if piece == 0 else capacity)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of the documents: id, piece, start, length, ids_crc32. Null text: the end id alone."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                ids = encode(text) + end
                for piece, start, length in cut(len(ids) // 4, capacity):
                    rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return slim.mapInPandas(pieces, "id long, piece int, start long, length long, ids_crc32 long")


def knapsacks(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of values, how often each length goes into ``capacity`` at the most value, and that value.

    ``values[k, l]`` is the value of length l, -inf if there is none. The dynamic program over room, all rows at
    once; of equally good lengths the longest is taken.
    """
    rows = np.arange(len(values))
    best, pick = np.zeros((len(rows), capacity + 1)), np.zeros((len(rows), capacity + 1), dtype=np.int64)
    backwards = np.ascontiguousarray(values[:, ::-1])
    for room in range(1, capacity + 1):
        total = best[:, :room] + backwards[:, capacity - room : capacity]
        at = total.argmax(axis=1)
        found = total[rows, at]
        better = found > best[:, room - 1]
        best[:, room] = np.where(better, found, best[:, room - 1])
        pick[:, room] = np.where(better, room - at, 0)
    counts, room = np.zeros(values.shape, dtype=np.int64), np.full(len(rows), capacity)
    while (room > 0).any():
        length = pick[rows, room]
        counts[rows, length] += length > 0
        room = np.maximum(room - np.maximum(length, 1), 0)
    counts[:, 0] = 0
    return counts, best[:, capacity]


def best_fit(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on a histogram: bins of one content are handled together."""
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    groups_full: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for length in sorted(demand, reverse=True):
        left = demand[length]
        while left:
            rooms = [r for r in groups if r >= length]
            if not rooms:
                each = min(left, capacity // length)
                content, bins = ((length, each),), left // each
            else:
                room = min(rooms)
                old, have = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                each = min(room // length, left)
                bins = min(have, left // each)
                if have > bins:
                    groups[room].append((old, have - bins))
                content = (*old, (length, each))
            left -= each * bins
            room = capacity - sum(x * n for x, n in content)
            if room:
                groups[room].append((content, bins))
            else:
                groups_full.append((content, bins))
    return [(dict(c), n) for c, n in groups_full + [x for g in groups.values() for x in g]]


def configuration_lp(
    demand: dict[int, int],
    capacity: int,
    rate: float = 0.1,
    gap: float = 0.005,
    lean: float = 0.05,
    most_rounds: int = 120,
    steps: int = 60,
    together: int = 64,
    variants: int = 4,
) -> tuple[dict[tuple, float], float]:
    """Fractional patterns that cover the histogram with few sequences, by multiplicative weights, and a lower bound.

    The linear program: as few sequences as possible, each length covered by its demand. A length's weight, at first
    its tokens to the power 1 + ``lean``, shrinks by the factor exp(-``rate``) each time its whole
    demand has been covered once; weight over demand is its price. A round prices all patterns at
    once by the knapsack program (with slightly changed prices too, for ``variants`` patterns), and then
    makes ``steps`` steps: the patterns within half the rate of the best price, ``together`` at most,
    are taken as often as covers the scarcest of their lengths once, so no coverage jumps. Prices divided by the best
    pattern's are a solution of the dual, so their sum over all pieces is a lower bound, as is tokens /
    capacity. It ends when the covering, scaled to the least covered length, is within ``gap`` of
    the best bound, or after ``most_rounds``.
    """
    size = np.array(sorted(demand))
    need, place = np.array([demand[x] for x in size], dtype=float), {int(x): i for i, x in enumerate(size)}
    known: dict[tuple, int] = {}
    rows, counts = [], []

    def learn(pattern: dict[int, int]) -> None:
        key = tuple(sorted(pattern.items(), reverse=True))
        if key not in known:
            known[key] = len(rows)
            rows.append(np.array([place[x] for x, _ in key]))
            counts.append(np.array([n for _, n in key], dtype=float))

    for pattern, _ in best_fit(demand, capacity):
        learn(pattern)
    rng = np.random.default_rng(20240229)
    start = np.log(size ** (1 + lean) * need)
    covered, taken = np.zeros(len(size)), np.zeros(0)
    bound = float((size * need).sum() / capacity)

    def prices() -> np.ndarray:
        log_weight = start - rate * covered
        return np.exp(log_weight - log_weight.max()) / need

    for _ in range(most_rounds):
        price = prices()
        values = np.full((variants, capacity + 1), -np.inf)
        values[:, size] = price
        values[1:, size] *= 1 + 0.01 * (rng.random((variants - 1, len(size))) - 0.5)
        found, best = knapsacks(values, capacity)
        bound = max(bound, float((price * need).sum() / best[0]))
        for row in found:
            learn({int(x): int(row[x]) for x in np.flatnonzero(row)})
        taken = np.concatenate([taken, np.zeros(len(rows) - len(taken))])
        flat, times = np.concatenate(rows), np.concatenate(counts)
        first = np.cumsum([0, *[len(r) for r in rows[:-1]]])
        for _ in range(steps):
            worth = np.add.reduceat(prices()[flat] * times, first)
            top = np.argsort(-worth, kind="stable")[:together]
            top = top[worth[top] >= (1 - rate / 2) * worth[top[0]]]
            gain = np.zeros(len(size))
            for t in top:
                gain[rows[t]] += counts[t]
            step = (need[gain > 0] / gain[gain > 0]).min()
            covered += gain * step / need
            taken[top] += step
        least = covered.min()
        if least > 0 and taken.sum() / least <= (1 + gap) * bound:
            break
    least = covered.min()
    return {p: taken[i] / least for p, i in known.items() if taken[i]} if least > 0 else {}, bound


def pack_histogram(demand: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Patterns (length -> count) with their numbers of sequences that hold the histogram exactly, and a lower bound of these.

    The configuration LP's patterns are rounded down, then up once each, the largest fractions
    first, as long as their pieces last. What that leaves, pieces that no pattern in use takes whole and whose number
    doesn't grow with the corpus, is packed best fit decreasing.
    """
    demand = {int(x): int(n) for x, n in demand.items() if n > 0}
    full = demand.pop(capacity, 0)
    plan, bound = [({capacity: 1}, full)] if full else [], 0.0
    left = dict(demand)

    def take(pattern: tuple, times: int) -> None:
        times = min(times, *[left[x] // n for x, n in pattern])
        if times > 0:
            plan.append((dict(pattern), times))
            for x, n in pattern:
                left[x] -= n * times

    if demand:
        fractions, bound = configuration_lp(demand, capacity)
        for pattern, times in sorted(fractions.items(), key=lambda x: -x[1]):
            take(pattern, int(times + 1e-6))
        for pattern, times in sorted(fractions.items(), key=lambda x: int(x[1] + 1e-6) - x[1]):
            take(pattern, 1 if times - int(times + 1e-6) > 1e-6 else 0)
    plan += best_fit({x: n for x, n in left.items() if n}, capacity)
    return plan, full + bound


def place_table(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: where its sequences and offsets begin. Sorted by (length, rank)."""
    rows, ranks, first_sequence = [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for length, count in pattern.items():
            rows.append((length, ranks[length], first_sequence, times, offset))
            ranks[length] += count * times
            offset += count * length
        first_sequence += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "times", "offset"), columns, strict=True))


def _places(places: dict[str, np.ndarray]):
    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, own = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for x in np.unique(size):
            low, high = np.searchsorted(places["length"], [x, x + 1])
            mine = np.flatnonzero(size == x)
            run = low + np.searchsorted(places["rank"][low:high], own[mine], "right") - 1
            nth, which = np.divmod(own[mine] - places["rank"][run], places["times"][run])
            sequence[mine] = places["sequence"][run] + which
            offset[mine] = places["offset"][run] + nth * x
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return place


def best_fit_packing(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    slice_rows: int = 1_000,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; a row for each piece.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut,
    its first piece the short one. Columns: id, piece, start, length, ids_crc32,
    sequence_id, offset; offsets of a sequence are gapless from 0. Only the
    histogram of lengths, at most ``capacity`` numbers, reaches the driver. Ranks within a length are
    counted in slices of about ``slice_rows`` rows, dealt by a number of the row alone, so no
    length and no repeated row, however frequent, is numbered by one task.

    Null or empty text: the end id alone. Runs of blanks of any length and added tokens inside texts give
    the ids that ``tokenizers`` gives. Null id: the largest id. Repeated rows are packed
    each on its own. No rows: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    cut_up = token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)
    pieces = stored(cut_up.withColumn("salt", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = place_table(pack_histogram(histogram, capacity)[0], capacity)
    slices_of = spark.createDataFrame([(x, n // slice_rows + 1) for x, n in histogram.items()], "length long, slices long")
    sliced = pieces.join(F.broadcast(slices_of), "length").withColumn("slice", F.pmod(F.xxhash64("salt"), F.col("slices"))).drop("slices")
    order = Window.partitionBy("length", "slice").orderBy("id", "piece", "ids_crc32", "salt")
    ranked = sliced.withColumn("within", F.row_number().over(order) - 1)
    slices = sliced.groupBy("length", "slice").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("length").orderBy("slice")) - F.col("rows")
    slices = slices.select("length", "slice", before.alias("before"))
    ranked = ranked.join(slices, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("within"))
    placed = ranked.withColumn("place", _places(places)("length", "rank"))
    return placed.select(
        F.nullif(F.col("id"), F.lit(NO_ID)).alias(id_col), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed by the public byte-level vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit_packing(docs, default_tokenizer())
