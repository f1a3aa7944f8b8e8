"""JSON lines, CSV and Parquet as frames with an event time, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.payload import csv_event_time, is_json, json_event_time


def read_jsonl(spark: SparkSession, path: str, time_field: str, stream: bool = False, **options: object) -> DataFrame:
    """event_time and payload of a file, folder or pattern of JSON lines; one value of any kind a line.

    A line that is blank or not JSON ends the run. A time that is no whole number (epoch ms) or RFC 3339 text is the
    epoch. The payload keeps the text as it stands, so nothing is coerced.
    """
    reader = (spark.readStream if stream else spark.read).options(**{k: str(v) for k, v in options.items()})
    lines = reader.text(path)
    payload = F.when(~is_json(F.col("value")), F.raise_error(F.concat(F.lit("not a JSON line: "), F.substring("value", 1, 200)))).otherwise(F.col("value"))
    return lines.select(payload.alias("payload")).select(json_event_time(F.col("payload"), time_field).alias("event_time"), "payload")


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header of the first of the files."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns


def read_csv(spark: SparkSession, path: str, time_field: str, stream: bool = False, columns: list[str] | None = None, multi_line: bool | None = None) -> DataFrame:
    """event_time and all columns, as strings, of CSV files with a header; a row of another length ends the run.

    Empty fields are empty strings. A time that is no whole number of epoch ms, or a missing column, is the epoch.
    A column that is itself called event_time becomes the event time. Large files are split, unless a quoted field holds
    a line end (``multi_line``), when each file is one task's; None looks for such fields, in one pass over the lines of
    a batch. A stream is taken to have some.
    """
    if multi_line is None:
        # A quoted field that goes on in the next line leaves an odd number of quotes.
        multi_line = stream or not spark.read.text(path).filter((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()
    names = columns or csv_columns(spark, path)
    schema = ", ".join(f"`{n}` string" for n in names)
    reader = spark.readStream if stream else spark.read
    options = {"header": True, "mode": "FAILFAST", "multiLine": multi_line, "escape": '"', "nullValue": "\u0001", "enforceSchema": False}
    rows = reader.options(**options).schema(schema).csv(path)
    text = [F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names]
    at = csv_event_time(F.col(f"`{time_field}`")) if time_field in names else F.timestamp_millis(F.lit(0))
    rows = rows.select(*text).withColumn("_at", at)
    return rows.select(F.col("_at").alias("event_time"), *[f"`{n}`" for n in names if n != "event_time"])


def read_parquet(spark: SparkSession, path: str, time_field: str, stream: bool = False) -> DataFrame:
    """Parquet with its own columns, ``time_field`` also as event_time; filters and columns reach the scan."""
    if stream:
        rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    else:
        rows = spark.read.parquet(path)
    return rows if time_field == "event_time" else rows.withColumn("event_time", F.col(f"`{time_field}`"))
