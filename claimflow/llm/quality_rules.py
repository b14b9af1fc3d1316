"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio of trusted against raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import BLANKS, broadcast_if_small, stored, table, words_of

BUCKETS = 2**16
SYMBOLS = "#*$%&|<>"
WINDOW = 8
CACHE_WORDS = 300_000


class WordHashes(dict):
    """Stable 64-bit hashes of words; emptied when it has grown to its bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def gram_buckets(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's word unigrams and bigrams."""
    ones = hashes >> np.uint64(40)
    twos = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
    return (np.concatenate([ones, twos]) % np.uint64(buckets)).astype(np.int64)


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first occurrence included."""
    starts = len(hashes) - window + 1
    if starts < 2:
        return 0
    rolled = np.zeros(starts, dtype=np.uint64)
    for i in range(window):
        rolled = rolled * np.uint64(0x100000001B3) + hashes[i : i + starts]
        rolled ^= rolled >> np.uint64(29)
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(starts + window, dtype=np.int64)
    at = np.union1d(order[1:][same], order[:-1][same])
    twice[at] += 1
    twice[at + window] -= 1
    return int((np.cumsum(twice) > 0).sum())


def base_counts(text: str | None, words: list[str], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    seen: set[str] = set()
    lines = text.split("\n")
    repeated = 0
    for line in lines:
        if line in seen:
            repeated += 1
        elif line.strip(BLANKS):
            seen.add(line)
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), len(text) - sum(map(text.count, BLANKS)), symbols, repeated, repeated_words(hashes)


def gram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Counts of n-gram buckets over all rows, in trusted and in all text: bucket, trusted, raw. Partitions sum first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, sums = WordHashes(), np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            for text, trusted in zip(batch["text"], batch["trusted"], strict=True):
                own = np.bincount(gram_buckets(hashes.of(words_of(text)), buckets), minlength=buckets) if text else 0
                sums[1] += own
                if trusted:
                    sums[0] += own
        found = np.flatnonzero(sums[1])
        yield pd.DataFrame({"bucket": found.astype(np.int32), "trusted": sums[0][found], "raw": sums[1][found]})

    rows = docs.mapInPandas(count, "bucket int, trusted long, raw long")
    return rows.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw"))


def log_ratios(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log of trusted over raw probability of each bucket, smoothed by half a count. ``buckets`` numbers reach the driver."""
    found = gram_counts(docs, buckets).toPandas()
    trusted, raw = np.zeros(buckets), np.zeros(buckets)
    trusted[found["bucket"]], raw[found["bucket"]] = found["trusted"], found["raw"]
    if not trusted.sum():
        return np.zeros(buckets)
    return np.log((trusted + 0.5) / (trusted + 0.5).sum()) - np.log((raw + 0.5) / (raw + 0.5).sum())


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    least_words: int = 20,
    most_repeated: int = 30,
    threshold: float = -0.2,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Base counts of every text and its verdict by log-likelihood ratio.

    The trusted target is all text of rows labelled 1 in ``labels``; the raw corpus all rows. Each
    is a multinomial over ``buckets`` hashed word unigrams and bigrams. ``llr`` is the mean of
    log(trusted / raw) over a text's n-grams; a text is kept if it passes the base
    rules (``least_words`` words; at most ``most_repeated`` per cent of words in repeated
    windows) and ``llr >= threshold``. Both multinomials count all rows, whole texts.

    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr. Null or
    empty text: no words, so base_failed. No trusted rows: every llr is 0. An id that
    any label row marks 1 and none 0 is trusted; null ids never are. Repeated rows
    count each. No rows: no rows. Other columns are ignored.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.min(quality_col).alias("mark"))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    trusted = broadcast_if_small(stored(marks.where(F.col("mark") == 1).select("lid"), "trusted"))
    marked = slim.join(trusted, F.col("id") == F.col("lid"), "left")
    ratios = log_ratios(marked.select("text", F.col("lid").isNotNull().alias("trusted")), buckets).astype(np.float32)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows, ratio = [], []
            for text in batch["text"]:
                words = words_of(text)
                own = hashes.of(words)
                rows.append(base_counts(text, words, own))
                grams = gram_buckets(own, buckets)
                ratio.append(float(ratios[grams].mean(dtype=np.float64)) if len(grams) else 0.0)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            out = pd.DataFrame(rows, columns=names, dtype=np.int64).assign(llr=ratio)
            out["base_failed"] = (out["n_words"] < least_words) | (100 * out["n_repeat_words"] > most_repeated * out["n_words"])
            out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
            yield out.assign(id=batch["id"])

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    kind = dict(slim.dtypes)["id"]
    judged = slim.mapInPandas(judge, f"{counts}, llr double, base_failed boolean, kept boolean, id {kind}")
    order = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
    return judged.select(F.col("id").alias(id_col), *order)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """:func:`quality_rules` of all ``documents``, trusting the texts that ``labels`` marks 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
