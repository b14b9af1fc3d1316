"""Shared pieces of the training-data operators: words, keys, scratch tables.

Rules that all operators of this subpackage share:

* Only the named id and text columns are read, so extra columns, whatever
  their names, change nothing.
* A null text has no words; a null id is an id of its own that sorts last.
* A scratch table is written once and read by every later step, so a lost
  executor costs a re-read and never a different answer.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as text and as a Java / Python class.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = 2**63 - 1

_WORD = re.compile(WORD)
#: White space to str.split() that is no blank here.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def words_of(text: str | None) -> list[str]:
    """The words of one text: maximal runs without ASCII white space."""
    if not text:
        return []
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


#: Where :func:`slices` may cut: white space, which ends words for every operator.
_CUT = re.compile(r"[\x20\x09-\x0D]")


def slices(text: str, most_chars: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of about ``most_chars`` characters, each ending with white space or the text; no word is cut."""
    start = 0
    while len(text) - start > most_chars and (cut := _CUT.search(text, start + most_chars)):
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def ascii_lowered(text: str) -> str:
    """Lower-case A-Z alone."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are. Plain ASCII takes the faster way."""
    plain = F.octet_length(column) == F.char_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def word_array(column: Column) -> Column:
    """The words of a text as an array, empty for null."""
    parts = F.split(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def hash_pair(*parts: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, so that keys of a huge corpus don't clash."""
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and the master is local, as in
    tests, a temporary folder of this machine serves for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="claimflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``frame`` to the shared folder and return it as read from there."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    writer = frame.write.partitionBy(*partition_by) if partition_by else frame.write
    writer.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def broadcast_if_small(frame: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``frame``, a few columns of 8 bytes, with a broadcast hint if it has ``most_rows`` rows at most; else as it is.

    ``frame`` is read once more to count it, so it should be a written table.
    """
    return F.broadcast(frame) if frame.limit(most_rows + 1).count() <= most_rows else frame


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose id and text hash are in ``gone`` (columns id and th)."""
    keys = stored(gone.select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct(), "gone")
    keys = broadcast_if_small(keys)
    same_id = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == F.coalesce(keys["__id"].cast("long"), F.lit(NO_ID))
    return docs.join(keys, same_id & (text_hash(docs[text_col]) == keys["__th"]), "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % modulus


def chunks(texts: list[str], most_chars: int, most_rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most_chars`` characters and ``most_rows`` rows each, one row at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > most_chars or i - start >= most_rows):
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
