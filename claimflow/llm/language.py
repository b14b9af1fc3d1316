"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import chunks, crc_mod, table

ORDERS = (1, 2, 3)
BUCKETS = 2**15
CHUNK_CHARS = 500_000
UNDETERMINED = "und"


def gram_buckets(
    texts: list[str], orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, lower: bool = True
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: bucket and row number of every n-gram of the texts, in order.

    Texts are lower-cased if ``lower``; n-grams are of code points and don't cross texts.
    """
    lowered = [x.lower() for x in texts] if lower else texts
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(lowered)), [len(x) for x in lowered])
    mixed = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(orders) + 1):
        if len(codes) < n:
            return
        mixed = mixed[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        if n in orders:
            spread = mixed * np.uint32(0x9E3779B1)
            inside = row[: len(mixed)] == row[n - 1 :]
            yield ((spread ^ (spread >> np.uint32(15))) % np.uint32(buckets))[inside].astype(np.int64), row[: len(mixed)][inside]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def language_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Counts of n-gram buckets by language over all rows: lang, bucket, n; the bucket -1 counts the rows. Each partition sums its own first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        rows: Counter[str] = Counter()
        for batch in batches:
            texts, langs = batch["text"].tolist(), batch["lang"].to_numpy()
            for start, end in chunks(texts, CHUNK_CHARS):
                names, own = np.unique(langs[start:end].astype(str), return_inverse=True)
                total = np.zeros(len(names) * buckets, dtype=np.int64)
                for bucket, row in gram_buckets(texts[start:end], buckets=buckets):
                    total += np.bincount(own[row] * buckets + bucket, minlength=len(total))
                rows.update(dict(zip(names, np.bincount(own), strict=True)))
                for i, name in enumerate(names):
                    part = total[i * buckets : (i + 1) * buckets]
                    sums[name] = sums[name] + part if name in sums else part
        for name, total in sums.items():
            found = np.flatnonzero(total)
            yield pd.DataFrame({"lang": name, "bucket": np.append(found, -1).astype(np.int32), "n": np.append(total[found], rows[name])})

    rows = docs.mapInPandas(count, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of the buckets by language: a matrix of ``buckets`` times languages numbers."""

    def __init__(self, langs: list[str], log_prob: np.ndarray, prior: np.ndarray):
        self.langs, self.log_prob, self.prior = langs, log_prob, prior

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language and its posterior for each text.

        The sum of the log probabilities is divided by the root of the number of n-grams,
        as neighbouring n-grams are far from independent.
        """
        total, grams = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts))
        for start, end in chunks(texts, max(CHUNK_CHARS * 8 // (8 + len(self.langs)), 1)):
            for bucket, row in gram_buckets(texts[start:end], buckets=len(self.log_prob)):
                if end == start + 1:  # a text of any length is one vector of counts
                    total[start] += np.bincount(bucket, minlength=len(self.log_prob)) @ self.log_prob
                    grams[start] += len(bucket)
                    continue
                first = np.flatnonzero(np.diff(row, prepend=-1))
                if len(first):
                    at = start + row[first]
                    total[at] += np.add.reduceat(self.log_prob[bucket], first, axis=0)
                    grams[at] += np.diff(first, append=len(row))
        scaled = total / np.sqrt(np.maximum(grams, 1))[:, None]
        odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        best = np.argmax(total, axis=1)
        return best, odds[np.arange(len(texts)), best] / odds.sum(axis=1)


def fit(training: DataFrame, buckets: int = BUCKETS, most_langs: int = 512) -> Model | None:
    """Fit on every row with a language (columns text, lang); the prior is the share of rows. At most ``most_langs * buckets`` counts reach the driver."""
    counts = language_counts(training, buckets).toPandas()
    rows = counts[counts["bucket"] < 0].set_index("lang")["n"]
    counts = counts[counts["bucket"] >= 0]
    langs = sorted(rows.index)
    if not langs:
        return None
    if len(langs) > most_langs:
        raise ValueError(f"{len(langs)} languages; the matrix is held for {most_langs} at most")
    table_ = np.zeros((buckets, len(langs)))
    table_[counts["bucket"], counts["lang"].map({x: i for i, x in enumerate(langs)})] = counts["n"]
    smoothed = table_ + 0.5
    log_prob = np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32)
    share = rows.loc[langs].to_numpy() + 1
    return Model(langs, log_prob, np.log(share / share.sum()))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The likeliest language of every row: id, lang_pred, score."""

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            known = np.array([model is not None and has_letter(x) for x in texts], dtype=bool)
            langs, scores = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
            if known.any():
                best, odds = model.scores([x for x, k in zip(texts, known, strict=True) if k])
                langs[known], scores[known] = [model.langs[i] for i in best], odds
            yield pd.DataFrame({"id": batch["id"], "lang_pred": langs, "score": scores})

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(slim.dtypes)["id"]
    return slim.mapInPandas(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of every document, learnt from those whose crc32(id) mod 4 isn't 2 and whose language is known.

    Columns: id, held_out, lang_pred, score. Counts are of all training rows
    and whole texts; the matrix of log probabilities, its size set by languages and
    buckets alone, goes to each task with the code. Null text, a text without a letter, or no
    training rows: ``und`` with score 0. Equal scores: the language first by
    name. Null ids hold as the text ''. Repeated rows are counted and
    predicted each. No rows: no rows. Other columns are ignored.
    """
    held_out = crc_mod(F.col(id_col), 4) == 2
    training = docs.where(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    model = fit(training.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    found = identify(docs, model, id_col, text_col)
    return found.select(id_col, held_out.alias("held_out"), "lang_pred", "score")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """:func:`language_id` of all ``documents``."""
    return language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
