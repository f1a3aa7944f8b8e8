"""Kafka topics as frames with an event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.payload import decode_bytes, json_event_time, member_json


def starting_offsets(auto_offset_reset: str) -> str:
    """Where a new query starts: ``earliest`` at the beginning, anything else at the end."""
    return "earliest" if auto_offset_reset.lower() == "earliest" else "latest"


def read_kafka(spark: SparkSession, brokers: str, topic: str, time_field: str, group: str | None = None, auto_offset_reset: str = "latest", per_trigger: int | None = None, fail_on_data_loss: bool = True) -> DataFrame:
    """A stream of decoded messages. Offsets are kept in the query's checkpoint; ``per_trigger`` bounds a batch.

    Offsets that expired before they were read end the query, unless ``fail_on_data_loss`` is false.
    Needs Spark's Kafka connector on the class path.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
    reader = reader.option("startingOffsets", starting_offsets(auto_offset_reset)).option("failOnDataLoss", str(fail_on_data_loss).lower())
    if group:
        reader = reader.option("kafka.group.id", group)
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return decode_messages(reader.load(), time_field)


def decode_messages(messages: DataFrame, time_field: str) -> DataFrame:
    """event_time, payload, _topic, _partition, _offset of frames with Kafka's columns value, topic, partition, offset.

    JSON stays as it is, with the three position fields added to objects; other UTF-8 text becomes {"bytes": …}, other
    bytes {"bytes_b64": …}. A null value is a null payload with the epoch as its time.
    """
    body = messages.select(decode_bytes(F.col("value")).alias("_p"), F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), F.col("offset").alias("_offset"))
    names = ["_offset", "_partition", "_topic"]
    position = F.regexp_replace(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), r"^\{", "")
    inner = F.btrim(F.regexp_replace("_p", r"(?s)^\s*\{|\}\s*$", ""))
    added = F.concat(F.lit("{"), F.when(inner != "", F.concat(inner, F.lit(","))).otherwise(""), position)
    # An object that has such a field already loses it.
    members = F.map_filter(F.from_json("_p", "map<string, variant>"), lambda k, _: ~k.isin(names))
    rest = F.btrim(F.regexp_replace(F.to_json(members), r"(?s)^\{|\}$", ""))
    replaced = F.concat(F.lit("{"), F.when(rest != "", F.concat(rest, F.lit(","))).otherwise(""), position)
    has = F.coalesce(*[member_json(F.col("_p"), n) for n in names]).isNotNull()
    payload = F.when(~F.coalesce(F.ltrim("_p").startswith("{"), F.lit(False)), F.col("_p")).when(has, replaced).otherwise(added)
    return body.select(json_event_time(F.col("_p"), time_field).alias("event_time"), payload.alias("payload"), "_topic", "_partition", "_offset")
