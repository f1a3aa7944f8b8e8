"""JSON lines and partitioned Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.payload import date_pattern, member_json, member_text, payload_json


def as_payload(df: DataFrame, skip: tuple[str, ...] = ("event_time",)) -> DataFrame:
    """event_time and the other columns as one JSON payload; a frame that has just these two stays as it is."""
    if set(df.columns) == {"event_time", "payload"}:
        return df
    return df.select("event_time", payload_json(df, [c for c in df.columns if c not in skip]).alias("payload"))


def write_json_lines(df: DataFrame, path: str | None, mode: str = "append") -> None:
    """One compact JSON object a line, without the event time; to standard output without a path.

    Standard output is for small results: lines pass the driver one partition at a time.
    """
    lines = df.select("payload") if set(df.columns) == {"event_time", "payload"} else df.select(payload_json(df, [c for c in df.columns if c != "event_time"]).alias("payload"))
    if path is None:
        for row in lines.toLocalIterator():
            print(row[0])
    else:
        lines.write.mode(mode).text(path)


@dataclass(frozen=True)
class ByDate:
    """Partitions by a date; ``field`` event_time is formatted, another member counts as it stands, if it is a string."""

    field: str = "event_time"
    fmt: str = "%Y-%m-%d"


@dataclass(frozen=True)
class ByField:
    """Partitions by a payload member: strings raw, other kinds as JSON, empty where it is missing."""

    field: str


def partition_value(spec: ByDate | ByField, payload: Column, zoned: bool) -> Column:
    """The value of the ``dt`` partition, empty without one; dates are UTC dates, whatever the session's zone.

    ``zoned`` says that event_time is an instant, not a time without a zone, which already means UTC.
    """
    if isinstance(spec, ByField):
        return F.coalesce(member_text(payload, spec.field), F.lit(""))
    if spec.field == "event_time":
        at = F.convert_timezone(None, F.lit("UTC"), F.col("event_time")) if zoned else F.col("event_time")
        return F.date_format(at, date_pattern(spec.fmt))
    return F.when(member_json(payload, spec.field).startswith('"'), member_text(payload, spec.field)).otherwise("")


def compression(name: str | None) -> str:
    """snappy where none is named; zstd; anything else is not compressed."""
    return {"snappy": "snappy", "zstd": "zstd"}.get((name or "snappy").lower(), "none")


@dataclass(frozen=True)
class ParquetSink:
    """Where and how payloads are written: a folder per partition, files of ``max_rows`` rows or ``max_bytes`` at most."""

    path: str
    partition: ByDate | ByField = ByDate()
    max_rows: int = 100_000
    max_age_ms: int | None = 60_000
    max_bytes: int | None = None
    codec: str | None = None

    def layout(self, df: DataFrame) -> DataFrame:
        """event_time, payload, dt."""
        rows = as_payload(df)
        zoned = isinstance(rows.schema["event_time"].dataType, T.TimestampType)
        return rows.select("event_time", "payload", partition_value(self.partition, F.col("payload"), zoned).alias("dt"))

    def rows_a_file(self, bytes_a_row: float | None = None) -> int:
        """The row limit of a file, by rows and by the estimate of bytes."""
        if self.max_bytes and bytes_a_row:
            return max(1, min(self.max_rows, int(self.max_bytes / bytes_a_row)))
        return self.max_rows

    def write(self, df: DataFrame, mode: str = "append") -> None:
        """Writes a batch. Empty and null partition values go to the default partition's folder."""
        rows = self.layout(df)
        each = rows.agg(F.avg(F.octet_length("payload"))).first()[0] if self.max_bytes else None
        writer = rows.write.mode(mode).partitionBy("dt").option("compression", compression(self.codec))
        writer.option("maxRecordsPerFile", self.rows_a_file(each)).parquet(self.path)

    def start(self, df: DataFrame, checkpoint: str):
        """Writes a stream; each batch closes its files, so ``max_age_ms`` is the time between batches."""
        rows = self.layout(df).observe("written", F.sum(F.octet_length("payload")).alias("bytes"))
        writer = rows.writeStream.format("parquet").partitionBy("dt").option("path", self.path).option("checkpointLocation", checkpoint)
        writer = writer.option("compression", compression(self.codec)).option("maxRecordsPerFile", self.max_rows)
        return (writer.trigger(processingTime=f"{self.max_age_ms} milliseconds") if self.max_age_ms else writer).start()
