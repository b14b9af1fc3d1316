"""Phrase collocations by Toivonen's method: a sample proposes, full passes count proposals and their border exactly until nothing is left open."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.llm.common import ascii_lowered, slices, stored, table, words_of

#: Characters that end a piece; as a token of its own, one of them marks the place. No word holds it.
_EDGES, EDGE = re.compile(r"[.,;:!?\x0A-\x0D]+"), "."
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, phrase string, digest long, n long"
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("digest", pa.int64()), ("n", pa.int64())])


def tokens_of(text: str) -> list[str]:
    """Lower-cased (A-Z) words of a text, with ``EDGE`` between its pieces."""
    return words_of(_EDGES.sub(f" {EDGE} ", ascii_lowered(text)))


def word_hashes(words: list[str] | np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)


def longer_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase made of that of all its words but the last and that of the last."""
    mixed = first * _MULTIPLIER
    return (mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIER + last


class Proposed:
    """A set of phrases as a bitmap of fixed size. It may hold a few more: those are counted too, exactly, and change nothing."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def slots(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        """Two places of each hash among ``size`` bits, a power of two."""
        mask = np.uint64(size - 1)
        return [(hashes >> np.uint64(32)) & mask, (hashes * _MULTIPLIER) >> np.uint64(20) & mask]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for slot in self.slots(hashes, len(self.bits) * 64):
            found &= (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return found


def count_grams(tokens: list[str], carried: int, seed: np.uint64, most_words: int, before: Proposed | None, now: Proposed | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases of a token list that a pass has to count, length by length: where one stands, its digest, how often it stands.

    A candidate is a phrase whose contiguous parts are all in ``now``, a word or, without ``now``, any phrase. Of a candidate in ``now`` the
    place counts and the digest is 0, of any other the digest and the place is -1. What the pass with ``before`` has counted in the
    same way is left out, and so are phrases that end in the first ``carried`` tokens: they were counted with the tokens before.
    """
    codes, words = pd.factorize(np.array(tokens, dtype=object))
    if not len(words):
        return
    is_word = np.array([w != EDGE for w in words])
    hashes = word_hashes(words) ^ seed
    no = np.zeros(len(codes), dtype=bool)
    # of each window of k tokens: the number of its phrase, whether that is a candidate now and was one before
    number, each, at, fresh, old = codes, hashes, None, is_word[codes], is_word[codes] if before else no
    for k in range(1, most_words + 1):
        start = np.flatnonzero(fresh)
        if k > 1:
            if not len(start):
                return
            last = codes[start + k - 1]
            keys, first, place = np.unique(number[start].astype(np.int64) * len(words) + last, return_index=True, return_inverse=True)
            at, was = start[first], each
            each = longer_hash(was[number[at]], hashes[last[first]])
            number = np.full(len(fresh), 0, dtype=np.int64)
            number[start] = place
        held_now = now.holds(each) if now else np.zeros(len(each), dtype=bool)
        held_before = before.holds(each) if before else np.zeros(len(each), dtype=bool)
        mine = number[start]
        asked = np.where(held_now[mine], ~(old[start] & held_before[mine]), ~old[start]) & (start + k > carried)
        n = np.bincount(mine[asked], minlength=len(each))
        own = np.flatnonzero(n)
        places = np.full(len(each), -1, dtype=np.int64)
        places[number[start]] = start
        yield np.where(held_now[own], places[own], -1), np.where(held_now[own], np.uint64(0), each[own]), n[own]
        if now:
            fresh = fresh & held_now[number]
            old = old & held_before[number] if before else old
        if len(fresh) < 2:
            return
        fresh, old = fresh[:-1] & fresh[1:], old[:-1] & old[1:]


def lang_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 7))


def counts(rows: DataFrame, most_words: int, before: Proposed | None, now: Proposed | None, most_tokens: int = 1 << 17) -> DataFrame:
    """Counts over ``rows`` (lang, text) of what :func:`count_grams` asks for: lang, phrase, digest, n.

    Rows with a phrase are exact; those with a digest alone, which stands for language and phrase, may be too high if digests
    meet. Tokens of some texts of a language are counted together; a long text is taken in slices, each with
    the last words of the one before. The row of the empty phrase holds the number of words, in a first pass.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        waiting = 0

        def flushed(lang: str, tokens: list[str], carried: int) -> Iterator[pa.RecordBatch]:
            if before is None and (total := sum(1 for t in tokens[carried:] if t != EDGE)):
                yield pa.RecordBatch.from_pydict({"lang": [lang], "phrase": [""], "digest": [0], "n": [total]}, schema=_SCHEMA)
            for k, (places, digests, n) in enumerate(count_grams(tokens, carried, lang_seed(lang), most_words, before, now), 1):
                named = places >= 0
                phrases = [" ".join(tokens[i : i + k]) for i in places[named].tolist()]
                if phrases:
                    same = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(phrases), dtype=np.int64)))
                    yield pa.RecordBatch.from_arrays([same, pa.array(phrases, pa.string()), pa.array(digests[named].view(np.int64)), pa.array(n[named])], schema=_SCHEMA)
                if not named.all():
                    none = pa.nulls(int((~named).sum()), pa.string())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(digests[~named].view(np.int64)), pa.array(n[~named])], schema=_SCHEMA)

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, lang in enumerate(langs):
                tokens = held.setdefault(lang, [])
                carried, size = 0, len(tokens)
                for part in slices(batch.column("text")[i].as_py()):
                    tokens += tokens_of(part)
                    if len(tokens) >= most_tokens:
                        yield from flushed(lang, tokens, carried)
                        tokens = held[lang] = tokens[-(most_words - 1) :]
                        carried = len(tokens)
                if carried:  # what is left of a long text is counted by itself
                    yield from flushed(lang, tokens, carried)
                    tokens = held[lang] = []
                tokens.append(EDGE)
                waiting += len(tokens) - size
                if waiting >= 8 * most_tokens:  # many languages
                    for each, rest in held.items():
                        yield from flushed(each, rest, 0)
                    held.clear()
                    waiting = 0
        for lang, tokens in held.items():
            yield from flushed(lang, tokens, 0)

    return rows.mapInArrow(tally, COUNTS).groupBy("lang", "phrase", "digest").agg(F.sum("n").alias("n"))


def proposals(digests: DataFrame, words: int, known: Proposed | None = None) -> Proposed:
    """The phrases of ``digests``, and those of ``known``, as a bitmap of ``words`` 64-bit words.

    Tasks set bits in maps of their own, which are joined by or; the driver gets the map, whose size is fixed.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(words, dtype=np.uint64)
        for batch in batches:
            for slot in Proposed.slots(batch["digest"].to_numpy().view(np.uint64), words * 64):
                np.bitwise_or.at(bits, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pd.DataFrame({"at": at, "bits": bits[at].view(np.int64)})

    marked = digests.select("digest").mapInPandas(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(words, dtype=np.uint64) if known is None else known.bits.copy()
    if marked.num_rows:
        bits[marked["at"].to_numpy()] |= marked["bits"].to_numpy().view(np.uint64)
    return Proposed(bits)


def frequent_phrases(docs: DataFrame, lang_col: str, text_col: str, most_words: int, least: int, sample: float, filter_words: int) -> tuple[DataFrame, DataFrame]:
    """Written table of all phrases of ``most_words`` words at most that stand ``least`` times or more, and the words of each language.

    A sample of the texts proposes phrases: those found there as often as a phrase at the bound would be on average, twice at least. A full pass counts
    proposals and their negative border: phrases that aren't proposed but whose contiguous parts all are (words always). The border,
    by far the larger part, is counted by digests, which can only overstate. What reaches ``least`` there is a failure of the sample: it is
    proposed too, and another pass counts it exactly and what thereby enters the border, and only that. A phrase's parts
    are as frequent as itself, so when a border holds no failure all frequent phrases are counted: ``most_words`` + 1 passes at most.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rounds = 10_000
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) < int(sample * rounds))
    found = counts(drawn, most_words, None, None).where((F.col("n") >= max(2, round(least * sample))) & F.col("phrase").isNull())
    now, before, tables = proposals(found, filter_words), None, []
    while True:
        tables.append(stored(counts(rows, most_words, before, now).where((F.col("n") >= least) | (F.col("phrase") == "")), "phrases"))
        failures = tables[-1].where("phrase IS NULL")
        if failures.isEmpty():
            break
        before, now = now, proposals(failures, filter_words, now)
    words = stored(tables[0].where("phrase = ''").select("lang", F.col("n").alias("words")), "words")
    exact = [t.where((F.col("phrase") != "") & (F.col("n") >= least)).select("lang", "phrase", "n") for t in tables]
    return stored(reduce(DataFrame.unionByName, exact), "frequent"), words


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    most_words: int = 3,
    least: int = 10,
    top: int = 2000,
    sample: float = 0.1,
    filter_words: int = 1 << 20,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``most_words`` words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces, these at blanks and tabs into words. a counts the phrase within
    pieces, overlaps included; only phrases with a >= ``least`` are candidates. l and r count its two parts at the cut that gives
    the lowest score, floor(1000000 * a * a / (l * r)), the smallest cut where equal; n is the number of the language's words. A candidate
    that stands inside a longer one with half of its count or more goes. Order: score, a, both descending, then phrase in byte order.
    ``filter_words`` is the size of the map of proposed phrases, in 64-bit words; a full map only makes passes count more.

    Counts come from :func:`frequent_phrases`. Arithmetic is exact for counts up to 10^14. Null lang: ``und``. Null or empty texts have no
    words. Repeated rows count each time. No rows: no rows. Other columns are ignored.
    """
    if least < 1 or top < 1 or most_words < 2:
        raise ValueError("least and top must be 1 or more, most_words 2 or more")
    frequent, words = frequent_phrases(docs, lang_col, text_col, most_words, least, sample, filter_words)
    parts = F.split("phrase", " ")
    sized = frequent.select("lang", "phrase", F.col("n").alias("a"), parts.alias("w")).where(F.size("w") >= 2)
    join = lambda w: F.array_join(w, " ")

    cut = sized.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", join(F.slice("w", F.lit(1), F.col("k"))).alias("left"), join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("right"))
    left, right = (frequent.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0])) for side in ("left", "right"))
    counted = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(15,0)")
    counted = counted.withColumn("top", big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("bottom", big("l") * big("r"))
    counted = counted.withColumn("score", F.expr("top div bottom").cast("long"))
    scored = counted.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: join(F.slice("w", i, k)))))
    held = sized.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left_over = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))

    order = F.col("best.score").desc(), F.col("a").desc(), F.col("phrase")
    # a language's candidates may be many: the best of each of 64 shares first
    shared = left_over.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(words) if words.limit(10_001).count() <= 10_000 else words, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", F.col("words").alias("n"), "best.score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS lengths(k))
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 10),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS x, array_to_string(w[j + 1 : k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scores AS (
  SELECT c.lang, c.phrase, c.a, j, p.a AS l, q.a AS r, CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(p.a AS HUGEINT) * q.a) AS BIGINT) AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = x JOIN f q ON q.lang = c.lang AND q.phrase = y
), best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best b LEFT JOIN held h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
