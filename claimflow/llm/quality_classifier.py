"""Quality classifier: similarity-weighted votes of the nearest labelled latent-semantic vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import chunks, crc_mod, table, words_of
from claimflow.llm.language import gram_buckets

#: Buckets of character n-grams; then the terms of word recurrence: bits of the distance (0: first use) by word length.
BUCKETS = 4096
MOST_BITS, MOST_LENGTH = 11, 15
WIDTH = BUCKETS + (MOST_BITS + 1) * (MOST_LENGTH + 1)
CHUNK_CHARS, CHUNK_ROWS = 200_000, 128


def recurrence_terms(text: str) -> list[int]:
    """A term for each word: how many words ago it last stood, in powers of two, and how long it is."""
    last: dict[str, int] = {}
    out = []
    for at, word in enumerate(words_of(text)):
        ago = at - last.get(word, at)
        last[word] = at
        out.append(BUCKETS + min(ago.bit_length(), MOST_BITS) * (MOST_LENGTH + 1) + min(len(word), MOST_LENGTH))
    return out


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed character 1- to 3-grams and of word recurrences: a row for each text."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    flat = out.reshape(-1)
    for bucket, row in gram_buckets(texts, buckets=BUCKETS, lower=False):
        if len(bucket):
            flat += np.bincount(row * WIDTH + bucket, minlength=len(flat))
    for i, text in enumerate(texts):
        out[i] += np.bincount(np.array(recurrence_terms(text), dtype=np.int64), minlength=WIDTH)
    return out


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows: in how many each term occurs, and their number. ``WIDTH`` sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(WIDTH, dtype=np.int64), 0
        for batch in batches:
            texts = batch["text"].tolist()
            for start, end in chunks(texts, CHUNK_CHARS, CHUNK_ROWS):
                total += (term_counts(texts[start:end]) > 0).sum(axis=0)
                rows += end - start
        yield pd.DataFrame({"term": np.arange(-1, WIDTH, dtype=np.int32), "n": np.concatenate([[rows], total])})

    sums = docs.select("text").mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(WIDTH + 1, dtype=np.int64)
    for r in sums:
        found[r["term"] + 1] = r["n"]
    return found[1:], int(found[0])


class Space:
    """The latent space: idf weights, term vectors, and the labelled vectors with their labels and weights.

    Each label's rows weigh its share of all labelled rows over its share of the sample, so that the sample's mix doesn't
    decide scores. ``mean`` is the share of label 1 of all labelled rows.
    """

    def __init__(self, idf: np.ndarray, counts: np.ndarray, labels: np.ndarray, totals: tuple[int, int], dims: int):
        self.idf = idf.astype(np.float32)
        weighted = self.weigh(counts)
        # singular value decomposition by way of the samples' products
        values, vectors = np.linalg.eigh(weighted.astype(np.float64) @ weighted.T)
        top = [i for i in np.argsort(values)[::-1][:dims] if values[i] > 1e-9]
        self.terms = (weighted.T @ (vectors[:, top] / np.sqrt(values[top]))).astype(np.float32)
        self.vectors, self.labels = self.latent(weighted), labels.astype(np.float64)
        share = np.array(totals) / np.maximum(np.bincount(labels, minlength=2), 1)
        self.votes, self.mean = share[labels] / share.max(), totals[1] / sum(totals)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """Log counts times idf; n-grams and recurrences are vectors of length 1 each, side by side."""
        out = np.log1p(counts) * self.idf
        for part in (out[:, :BUCKETS], out[:, BUCKETS:]):
            part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        return out

    def latent(self, weighted: np.ndarray) -> np.ndarray:
        found = weighted @ self.terms
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str], neighbours: int, sharpness: float) -> np.ndarray:
        """The similarity-weighted mean label of each text's nearest labelled vectors; all that tie with the last one vote."""
        counts = term_counts(texts)
        cosine = self.latent(self.weigh(counts)) @ self.vectors.T
        most = min(neighbours, cosine.shape[1])
        last = np.partition(cosine, -most, axis=1)[:, -most]
        near = cosine >= last[:, None] - 1e-6
        weight = np.where(near, np.maximum(cosine, 1e-3).astype(np.float64) ** sharpness * self.votes, 0)
        found = weight @ self.labels / weight.sum(axis=1)
        return np.where(counts.any(axis=1), np.clip(found, 0, 1), self.mean)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Term counts and labels of at most ``most`` labelled rows, half of each label where there are as many, the same rows every
    time; and how many labelled rows there are of each label.

    Texts are counted where they lie: what reaches the driver is ``most`` rows of ``WIDTH`` numbers, however long they are.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (crc_mod(F.col(id_col), 5) != 0))
    usable = usable.groupBy(F.col(id_col).alias("lid")).agg(F.min(label_col).alias("label"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("lid"), F.col(text_col).alias("text"))
    ids = texts.select("lid").distinct().join(usable, "lid").withColumn("draw", F.xxhash64("lid"))
    sizes = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = [ids.where(F.col("label") == x).orderBy("draw", "lid").limit(most // 2).select("lid", "label") for x in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most ``most`` ids
    rows = texts.join(chosen, "lid").groupBy("lid", "label").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [zlib.compress(term_counts([x]).tobytes(), 1) for x in batch["text"]]
            yield pd.DataFrame({"lid": batch["lid"], "label": batch["label"], "counts": packed})

    found = rows.mapInPandas(count, f"lid {dict(rows.dtypes)['lid']}, label int, counts binary").orderBy("lid").collect()
    counts = [np.frombuffer(zlib.decompress(r["counts"]), dtype=np.float32) for r in found]
    return np.array(counts).reshape(-1, WIDTH), np.array([r["label"] for r in found], dtype=np.int64), (sizes.get(0, 0), sizes.get(1, 0))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_samples: int = 2000,
    dims: int = 128,
    neighbours: int = 15,
    sharpness: float = 12.0,
    threshold: float = 0.3,
) -> DataFrame:
    """Score every text by its nearest labelled neighbours: ``docs`` with held_out, score and predicted.

    Texts are vectors of hashed character n-grams and of word recurrences (how far back a word last stood), log counts times
    idf; idf counts all rows and whole texts. The latent space is fitted on at most ``most_samples`` labelled rows whose
    crc32(id) mod 5 isn't 0, half of each label if there are as many; they, ``most_samples *
    dims`` numbers, go to every task. Each document's exact cosine with all
    of them is computed block by block, and the ``neighbours`` nearest, with all that tie with the last, vote, weighted by
    cosine to the power ``sharpness`` and by their label's share of all labelled rows over its
    share of the sample. predicted is 1 if score >= ``threshold``.

    Null or empty text: no terms, so its score is the share of label 1 of all labelled rows. No labelled
    rows: every score is 0.5. An id with both labels
    counts as 0. Null ids are scored and held out if crc32('') is. Repeated rows are scored each.
    No rows: no rows. Columns named like the added ones are replaced; others stay.
    """
    read = docs.drop("held_out", "score", "predicted")
    slim = read.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts, marks, totals = labelled_sample(read, labels, id_col, text_col, label_col, most_samples)
    space = None
    if len(marks):
        df, rows = document_frequency(slim)
        space = Space(np.log((1 + rows) / (1 + df)) + 1, counts, marks, totals, dims)
    sent = docs.sparkSession.sparkContext.broadcast(space)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        own, model = column.tolist(), sent.value
        if model is None:
            return pd.Series(np.full(len(own), 0.5))
        parts = [model.scores(own[a:b], neighbours, sharpness) for a, b in chunks(own, CHUNK_CHARS, CHUNK_ROWS)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    scored = read.withColumn("score", score(F.coalesce(F.col(text_col), F.lit(""))))
    held_out = crc_mod(F.col(id_col), 5) == 0
    return scored.withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """:func:`quality_scores` of all ``documents`` by ``labels.quality``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", "held_out", "score", "predicted")
