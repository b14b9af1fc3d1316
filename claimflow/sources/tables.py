"""Reading and writing of tables, fixtures and exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table in any format that Spark reads (parquet, json, csv, orc, jdbc); filters and columns reach the scan."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path) if path else reader.load()


def read_eval_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation replies from a JSON array."""
    return spark.read.option("multiLine", True).schema("id string, subject string, body string, from_email string").json(path)


def write_daily(frame: DataFrame, path: str, date_col: str = "date") -> None:
    """Write a daily table: only the dates in ``frame`` are replaced, so a run may be repeated."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def write_records(frame: DataFrame, path: str) -> None:
    """Write a text column of JSON records as lines."""
    frame.write.mode("overwrite").text(path)


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that ``spark.checkpoint.dir`` names; where that is unset, a temporary one for local masters alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="claimflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the scratch folder and read from there: later steps share it, and a lost executor costs a re-read."""
    path = f"{scratch_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
