"""Kafka topics as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import member_json, member_text
from tidemark.sinks.files import as_payload


def messages(df: DataFrame, key_field: str | None = None) -> DataFrame:
    """key and value as Kafka takes them; the key is a string member that is not empty, else null."""
    rows = as_payload(df)
    key = F.lit(None).cast("string")
    if key_field:
        text = member_text(F.col("payload"), key_field)
        key = F.when(member_json(F.col("payload"), key_field).startswith('"') & (text != ""), text)
    return rows.select(key.alias("key"), F.col("payload").alias("value"))


def write_kafka(df: DataFrame, brokers: str, topic: str, key_field: str | None = None, acks: str = "all", checkpoint: str | None = None, trigger: dict[str, str] | None = None):
    """Sends a batch, or starts a stream with ``checkpoint``. Needs Spark's Kafka connector on the class path."""
    out = messages(df, key_field)
    options = {"kafka.bootstrap.servers": brokers, "topic": topic, "kafka.acks": acks}
    if df.isStreaming:
        writer = out.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
    return out.write.format("kafka").options(**options).save()
