"""Line dedup: levelled sorted runs of line hashes, merge-anti-joined batch by batch.

Documents are taken in batches of ascending id. The keys of one batch are
merge-joined with the sorted runs of all earlier batches: a key that a run holds
has its first document there, so each of its lines in this batch goes; a new key
belongs to the batch's smallest id and becomes part of the batch's own run. Runs
are bucketed and sorted by hash, so the join with a run reads it in order and
shuffles nothing of it; after every ``fanout`` runs of a level they are compacted
into one run of the next level. Kept runs take further batches, today's or next month's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import BLANKS, NO_ID, ascii_lower, hash_pair, scratch_path, stored, table

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def batch_bounds(ids: DataFrame, batches: int) -> list[int]:
    """Ascending first ids of batches 2, 3, ...; ``batches`` numbers at most."""
    if batches < 2:
        return []
    at = [i / batches for i in range(1, batches)]
    found = ids.select(F.percentile_approx("id", F.array(*map(F.lit, at)), 1000).alias("q")).first()
    return sorted({int(x) for x in found["q"] or []})


class Runs:
    """Sorted runs of line hashes in levels; ``fanout`` runs of a level become one of the next.

    Runs are bucketed files; ``levels`` has their paths, so that a later job, in whatever session, goes on with
    ``Runs(spark, buckets, fanout, levels)``. They are entered in the session's catalog when they are opened.
    """

    def __init__(self, spark, buckets: int, fanout: int = 2, levels: list[list[str]] | None = None):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = [list(x) for x in levels or []]

    def paths(self) -> list[str]:
        return [path for level in self.levels for path in level]

    @staticmethod
    def _name(path: str) -> str:
        return path.rstrip("/").rpartition("/")[2].replace("-", "_")

    def open(self, path: str) -> DataFrame:
        """A run, with the layout that lets a join read its buckets in order."""
        name, keys = self._name(path), ", ".join(KEY)
        columns = ", ".join(f"{k} BIGINT" for k in KEY)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _write(self, keys: DataFrame) -> str:
        path = scratch_path(self.spark, "line-run")
        writer = keys.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", path).saveAsTable(self._name(path))
        return path

    def mark_seen(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``seen``: whether any run holds the key. A left join per run, each in hash order."""
        flags = []
        for i, path in enumerate(self.paths()):
            run = self.open(path).select(*KEY, F.lit(True).alias(f"in{i}"))
            keys = keys.join(run.hint("merge"), KEY, "left")
            flags.append(F.coalesce(F.col(f"in{i}"), F.lit(False)))
        seen = reduce(lambda a, b: a | b, flags, F.lit(False))
        return keys.select(*KEY, "owner", "n", seen.alias("seen"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch's own run and compact each level that is full."""
        new, level = self._write(keys), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            old = self.levels[level]
            new = self._write(reduce(DataFrame.unionByName, map(self.open, old)))
            self.drop(old)
            self.levels[level] = []
            level += 1

    def drop(self, paths: list[str]) -> None:
        """Take runs out of the catalog; their files go with the scratch folder."""
        for path in paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(path)}")


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line that is long enough: id, text hash, position, key hashes."""
    lines = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("id", "th", "pos", line_key(F.col("line")).alias("key"))
    h1, h2 = hash_pair(F.col("key"))
    return lines.where(F.char_length("key") >= min_chars).select("id", "th", "pos", h1.alias("h1"), h2.alias("h2"))


def lost_lines(own: DataFrame, keys: DataFrame, hot_share: int = 10_000) -> DataFrame:
    """Lines of a batch that go: id, th, pos. ``keys`` has owner, n and seen for each key of the batch.

    Keys that hold 1 / ``hot_share`` of the batch's lines or more, ``hot_share`` keys at most, are broadcast, so that
    no common line's rows meet in one task; all others are joined by hash.
    """
    repeated = keys.where(F.col("seen") | (F.col("n") > 1))
    total = keys.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("n") * hot_share >= F.lit(total)
    few = F.broadcast(repeated.where(hot).select(*KEY, "owner", "seen"))
    goes = F.col("seen") | (F.col("id") > F.col("owner"))
    common = own.join(few, KEY).where(goes)
    rare = own.join(few, KEY, "left_anti").join(repeated.where(~hot).select(*KEY, "owner", "seen"), KEY).where(goes)
    return common.select("id", "th", "pos").unionByName(rare.select("id", "th", "pos"))


def lines_left(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the sorted positions ``gone``; one pass over its lines."""
    before = lambda i: F.when(i > 0, F.get(gone, i - 1)).otherwise(F.lit(-1))
    runs = F.transform(F.sequence(F.lit(0), F.size(gone) - 1), lambda i: F.concat(F.array_repeat(F.lit(True), F.get(gone, i) - before(i) - 1), F.array(F.lit(False))))
    # the lines are an argument of zip_with, not of its function, so a text is split once
    marked = F.zip_with(F.split(text, "\n"), F.flatten(runs), lambda line, stays: F.when(F.coalesce(stays, F.lit(True)), line))
    return F.array_join(F.array_compact(marked), "\n")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    batches: int = 4,
    fanout: int = 2,
    batch_bytes: int = 256 * 2**30,
    runs: Runs | None = None,
) -> DataFrame:
    """Drop lines whose key an earlier document holds; ``docs`` with its columns and three more.

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of
    at least ``min_chars`` code points loses its lines everywhere but in the
    document of the smallest id that holds it, where all of them stay. The text
    column becomes the kept lines joined by ``\\n``; ``n_lines``, ``n_dropped`` and
    ``original_text`` are added. There are ``batches`` batches, or as many as keep them under
    ``batch_bytes`` of text.

    With ``runs`` all documents come after those whose lines the runs hold, whatever their ids; the runs
    take up the lines of this call too and stay for the next. Without, runs last for this call.

    Null or empty text: one empty line, never dropped; the text becomes ''. A null
    id is the largest id. Rows of one id are one document; each keeps its own row.
    Equal rows are treated alike. No rows: no rows. Columns of ``docs`` that are
    named like the added ones are replaced. Hash keys are 128 bits wide.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("th")
    )
    size = keyed.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bounds = batch_bounds(keyed.select("id"), max(batches, -(-size // batch_bytes)))
    batch = reduce(lambda a, b: a + b, [(F.col("id") >= b).cast("int") for b in bounds], F.lit(0))
    lines = stored(line_rows(keyed, min_chars).withColumn("batch", batch), "lines", "batch")

    kept_runs = runs is not None
    runs = runs if kept_runs else Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    dropped = []
    try:
        for b in range(len(bounds) + 1):
            own = lines.where(F.col("batch") == b).drop("batch")
            keys = own.groupBy(*KEY).agg(F.min("id").alias("owner"), F.count("*").alias("n"))
            keys = stored(runs.mark_seen(keys), "line-keys")
            if kept_runs or b < len(bounds):
                runs.add(keys.where(~F.col("seen")).select(*KEY))
            dropped.append(lost_lines(own, keys))
    finally:
        if not kept_runs:
            runs.drop(runs.paths())

    gone = reduce(DataFrame.unionByName, dropped).groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
    gone = gone.withColumnsRenamed({"id": "__id", "th": "__th"})
    text_now = F.col("original_text")
    kept = F.when(F.col("__gone").isNull(), text_now).otherwise(lines_left(text_now, F.col("__gone")))
    base = docs.drop("original_text", "n_lines", "n_dropped", "__id", "__th", "__gone").withColumn("original_text", text)
    joined = base.join(
        gone,
        (F.coalesce(base[id_col].cast("long"), F.lit(NO_ID)) == gone["__id"]) & (F.xxhash64(base["original_text"]) == gone["__th"]),
        "left",
    )
    return joined.withColumns(
        {
            text_col: kept,
            "n_lines": F.size(F.split(text_now, "\n")).cast("long"),
            "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        }
    ).drop("__id", "__th", "__gone")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``documents`` through :func:`dedup_lines`, texts as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, r, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.r, k.pos, k.line, coalesce(length(k.key) >= 10 AND k.doc_id > o.owner, false) AS gone
  FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, r
"""
