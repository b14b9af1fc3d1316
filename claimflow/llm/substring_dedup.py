"""Substring dedup: repeated lines and runs of sentences, found by their digests, with original offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.llm.common import LOWER, NO_ID, UPPER, stored, table

#: A unit ends with its line, or after a full stop, question or exclamation mark and a blank.
_END = re.compile(r"\n|[.!?] ")
_BREAKS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWERED = str.maketrans(UPPER, LOWER)
_UNIT_TYPE = "id long, th long, start int, end int, h1 long, h2 long"


def units_of(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each line or sentence; together they are the whole text."""
    start = 0
    for found in _END.finditer(text):
        yield start, found.end()
        start = found.end()
    if start < len(text):
        yield start, len(text)


def unit_key(unit: str) -> str:
    """A unit, normalised: A-Z lower-cased, runs of ASCII blanks and punctuation one blank, none at the ends."""
    return _BREAKS.sub(" ", unit.translate(_LOWERED)).strip(" ")


def digested_units(text: str, min_words: int, min_chars: int, min_line_chars: int = 1) -> Iterator[tuple[int, int, str]]:
    """Start, end and normal form of all that is keyed: runs of whole lines and sentences, and short lines.

    From each sentence the shortest run onwards that is long enough, and the shortest run back from its end; a long
    sentence is both. So a passage of whole sentences that is long enough lies in such runs from end to end, however
    short its sentences are. A line under the bounds is keyed too, by itself, if its normal form has ``min_line_chars``.
    """
    pieces = [(start, end, key, key.count(" ") + 1) for start, end in units_of(text) if (key := unit_key(text[start:end]))]
    keys, n, line = [p[2] for p in pieces], len(pieces), 0
    for i, (start, end, key, words) in enumerate(pieces):
        chars, last = len(key), i
        if words >= min_words and chars >= min_chars:
            yield start, end, key
        else:
            while last + 1 < n and (words < min_words or chars < min_chars):
                last += 1
                words, chars = words + pieces[last][3], chars + 1 + len(keys[last])
            if words >= min_words and chars >= min_chars:
                yield start, pieces[last][1], " ".join(keys[i : last + 1])
            words, chars, first = pieces[i][3], len(key), i
            while first and (words < min_words or chars < min_chars):
                first -= 1
                words, chars = words + pieces[first][3], chars + 1 + len(keys[first])
            if words >= min_words and chars >= min_chars:
                yield pieces[first][0], end, " ".join(keys[first : i + 1])
        if i + 1 == n or "\n" in text[end - 1 : pieces[i + 1][0]]:
            whole = " ".join(keys[line : i + 1])
            if len(whole) >= min_line_chars and (len(whole) < min_chars or whole.count(" ") + 1 < min_words):
                yield pieces[line][0], end, whole
            line = i + 1


def unit_rows(docs: DataFrame, min_words: int, min_chars: int, min_line_chars: int) -> DataFrame:
    """Place and 128-bit digest of each unit that is keyed, once."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, digests = [], []
            for doc, th, text in zip(batch["id"], batch["th"], batch["text"], strict=True):
                seen = set()
                for start, end, key in digested_units(text, min_words, min_chars, min_line_chars):
                    if (start, end) not in seen:
                        seen.add((start, end))
                        rows.append((doc, th, start, end))
                        digests.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["id", "th", "start", "end"], dtype=np.int64)
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield out.assign(h1=halves[:, 0], h2=halves[:, 1])

    return docs.mapInPandas(cut, _UNIT_TYPE)


def repeated_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, min_chars: int = 40, min_line_chars: int = 1
) -> DataFrame:
    """Every span that an earlier place holds too: id, th, start, end, first_id, first_start.

    Texts are cut into lines and these into sentences. Keyed by a 128-bit digest are the shortest
    runs of them, from each one on and from each one back, that have ``min_words`` words and
    ``min_chars`` characters of normal form, and whole lines under these bounds with ``min_line_chars`` at least (1: all lines; a
    higher bound leaves repeated short lines, such as greetings or brackets, in every document). So every
    repeated passage of that length is found in full but for its ragged ends: a sentence
    of which it holds only a part. Of each key the place with the smallest (id, text hash, start)
    stays; all others are returned, none twice: what lies in an earlier span of
    its text is left out, and one that begins in such a span begins at its end
    (first_start is then where the uncut run began). Every removed word has an earlier copy that stays.
    Offsets are code points of the original text, the end exclusive. Digests meet in sums made before the
    shuffle; only those found twice or more are joined back, a join that Spark may split at a hot digest.

    Null or empty text: no units. Null id: largest id. Rows of one id and text are
    one place; rows of one id and several texts are told apart by the text hash ``th``. No rows: no
    rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(ids.alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    units = stored(unit_rows(rows, min_words, min_chars, min_line_chars), "units")
    places = units.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "start")).alias("first"), F.max(F.struct("id", "th", "start")).alias("last"))
    places = places.where(F.col("first") != F.col("last")).drop("last")
    met = units.join(places, ["h1", "h2"]).where(F.struct("id", "th", "start") != F.col("first"))
    met = met.select("id", "th", "start", "end", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))
    met = met.dropDuplicates(["id", "th", "start", "end"])
    before = Window.partitionBy("id", "th").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0))).where("end > done")
    return met.withColumn("start", F.greatest("start", "done")).drop("done")


def drop_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the units that :func:`repeated_units` finds; ``removed`` keeps their spans in the original.

    ``removed`` is an array of (start, end, first_id, first_start), null where
    nothing was removed; a column of that name is replaced.
    """
    found = repeated_units(docs, id_col, text_col, **options)
    spans = found.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end", "first_id", "first_start"))).alias("removed"))
    spans = spans.withColumnsRenamed({"id": "__id", "th": "__th"})
    base = docs.drop("removed", "__id", "__th")
    text = F.coalesce(base[text_col], F.lit(""))
    joined = base.join(
        spans, (F.coalesce(base[id_col].cast("long"), F.lit(NO_ID)) == spans["__id"]) & (F.xxhash64(text) == spans["__th"]), "left"
    )
    starts = F.concat(F.array(F.lit(0)), F.transform("removed", lambda x: x["end"]))
    ends = F.concat(F.transform("removed", lambda x: x["start"]), F.array(F.char_length(text)))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a)), "")
    return joined.withColumn(text_col, F.when(F.col("removed").isNull(), text).otherwise(kept)).drop("__id", "__th")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents of ``documents`` that lose units to earlier ones: their spans, and how many characters go."""
    found = repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    span = F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))
    spans = F.array_sort(F.collect_set(F.struct("start", span.alias("span"))))
    grouped = found.groupBy("id", "th").agg(
        F.count("*").alias("n_removed"),
        spans.alias("spans"),
        F.min("first_id").alias("first_doc_id"),
        F.sum(F.col("end") - F.col("start")).alias("removed_chars"),
    )
    return grouped.select(
        F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"),
        "n_removed",
        F.array_join(F.transform("spans", lambda x: x["span"]), ",").alias("spans"),
        "first_doc_id",
        "removed_chars",
    )


OP6_SQL = r"""
WITH units AS (
  SELECT doc_id, generate_subscripts(u, 1) AS n, unnest(u) AS unit
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]*?(?:\n|[.!?] )|[^\n]+') AS u FROM documents)
), placed AS (
  SELECT doc_id, n, unit, CAST(sum(length(unit)) OVER w AS BIGINT) AS fin, sum(CAST(unit LIKE '%' || chr(10) AS INT)) OVER w - CAST(unit LIKE '%' || chr(10) AS INT) AS line
  FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), keyed AS (
  SELECT doc_id, n, line, fin - length(unit) AS start, fin,
         trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS key
  FROM placed
), pieces AS MATERIALIZED (
  SELECT doc_id, line, start, fin, key, length(key) AS chars, words, row_number() OVER w AS r, sum(words) OVER w AS up_words, sum(length(key) + 1) OVER w AS up_chars
  FROM (SELECT *, length(key) - length(replace(key, ' ', '')) + 1 AS words FROM keyed WHERE key <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), texts AS (SELECT doc_id, list(key ORDER BY r) AS keys, list(start ORDER BY r) AS starts, list(fin ORDER BY r) AS fins FROM pieces GROUP BY doc_id),
-- runs of pieces: long pieces, shortest runs on from each other one and back from it, short lines
near AS MATERIALIZED (
  SELECT a.doc_id, a.r AS i, b.r AS j, b.up_words - a.up_words + a.words AS words, b.up_chars - a.up_chars + a.chars AS chars, a.words >= 8 AND a.chars >= 40 AS i_long, b.words >= 8 AND b.chars >= 40 AS j_long
  FROM pieces a JOIN pieces b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r AND a.r + 40
), runs AS (
  SELECT doc_id, i, j FROM near WHERE i = j AND i_long
  UNION SELECT doc_id, i, min(j) FROM near WHERE NOT i_long AND words >= 8 AND chars >= 40 GROUP BY doc_id, i
  UNION SELECT doc_id, max(i), j FROM near WHERE NOT j_long AND words >= 8 AND chars >= 40 GROUP BY doc_id, j
  UNION SELECT doc_id, min(r), max(r) FROM pieces GROUP BY doc_id, line HAVING sum(words) < 8 OR sum(chars + 1) - 1 < 40
), spans AS MATERIALIZED (
  SELECT DISTINCT doc_id, starts[i] AS start, fins[j] AS fin, array_to_string(keys[i : j], ' ') AS key FROM runs JOIN texts USING (doc_id)
), firsts AS (SELECT key, min((doc_id, start)) AS kept FROM spans GROUP BY key HAVING min((doc_id, start)) <> max((doc_id, start))),
met AS (SELECT DISTINCT doc_id, start, fin, kept[1] AS first_id FROM spans JOIN firsts USING (key) WHERE (doc_id, start) <> kept),
opened AS (
  SELECT *, coalesce(max(fin) OVER (PARTITION BY doc_id ORDER BY start, fin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM met
), cut AS (SELECT doc_id, greatest(start, done) AS start, fin, first_id FROM opened WHERE fin > done)
SELECT doc_id, count(*) AS n_removed, string_agg(start || '-' || fin, ',' ORDER BY start) AS spans, min(first_id) AS first_doc_id, CAST(sum(fin - start) AS BIGINT) AS removed_chars
FROM cut GROUP BY doc_id
"""
