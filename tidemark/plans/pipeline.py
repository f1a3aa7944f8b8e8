"""Pipelines: built step by step, or from a configuration."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.durations import parse_duration_ms
from tidemark.functions.payload import member_json, member_text, text_number
from tidemark.operators import transforms
from tidemark.operators.watermark import end_watermark
from tidemark.operators.windows import Window, windowed_aggregate
from tidemark.plans.config import PipelineConfig
from tidemark.sinks.files import ByDate, ByField, ParquetSink, write_json_lines
from tidemark.sinks.kafka import write_kafka
from tidemark.sources.files import csv_columns, read_csv, read_jsonl
from tidemark.sources.kafka import read_kafka
from tidemark.streaming.metrics import Metrics


class Pipeline:
    """A frame and the steps on it; every step is a frame-to-frame function, so the plan stays Spark's to optimize."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._df: DataFrame | None = None
        self._sink: Callable[[DataFrame], object] | None = None
        self._seen: list[tuple[Observation, Metrics, str]] = []

    def source(self, df: DataFrame) -> Pipeline:
        self._df = df
        return self

    def apply(self, step: Callable[..., DataFrame], *args: object, **options: object) -> Pipeline:
        """Any operator, also one of your own."""
        self._df = step(self.frame, *args, **options)
        return self

    def map(self, columns: dict[str, Column]) -> Pipeline:
        return self.apply(transforms.map_columns, columns)

    def filter(self, keep: Column) -> Pipeline:
        return self.apply(transforms.filter_rows, keep)

    def key_by(self, field: str) -> Pipeline:
        return self.apply(transforms.key_by, field)

    def window(self, window: Window, key: str = "key", agg: str = "count", field: str | None = None, lateness_ms: int = 0) -> Pipeline:
        return self.apply(windowed_aggregate, window, key, agg, field, lateness_ms=lateness_ms)

    def measure(self, metrics: Metrics, operator: str) -> Pipeline:
        """Counts the rows that pass here while the plan runs (batch frames), without another job."""
        if not self.frame.isStreaming:
            seen = Observation(f"{operator}-{len(self._seen)}")
            self._df = self.frame.observe(seen, F.count(F.lit(1)).alias("rows"))
            self._seen.append((seen, metrics, operator))
        return self

    def sink(self, write: Callable[[DataFrame], object]) -> Pipeline:
        self._sink = write
        return self

    @property
    def frame(self) -> DataFrame:
        if self._df is None:
            raise ValueError("the pipeline has no source")
        return self._df

    def run(self) -> object:
        """Runs the plan into the sink; for a stream, what the sink returns is the running query."""
        frame = self.frame
        if self._sink is None:
            raise ValueError("the pipeline has no sink")
        out = self._sink(frame)
        for seen, metrics, operator in self._seen:
            # A sink that hands rows out one by one reports no figures; nothing waits for them then.
            reader = threading.Thread(target=lambda s=seen, m=metrics, o=operator: m.add("tidemark_operator_rows_total", s.get["rows"], operator=o), daemon=True)
            reader.start()
            reader.join(5)
        return out


def _read(spark: SparkSession, cfg: PipelineConfig) -> DataFrame:
    """event_time, _key and _value, as the aggregate needs them."""
    s, agg, by, field = cfg.source, cfg.agg, cfg.ops.count_by, cfg.ops.agg_field
    if s.kind == "file" and s.format == "csv":
        names = csv_columns(spark, s.path)
        raw = read_csv(spark, s.path, s.time_field, columns=names)
        # The event time column takes the place of one of the same name, whose text is then the number it came from.
        text = {n: F.col(f"`{n}`") if n != "event_time" else F.unix_millis("event_time").cast("string") for n in names}
        key = text.get(by, F.lit(None).cast("string"))
        value = text.get(field, F.lit(None).cast("string"))
        number = text_number(value)
        return raw.select("event_time", F.to_json(F.array(key)).alias("_q"), value.alias("_text"), number.alias("_number")).select(
            "event_time", F.expr("substring(_q, 2, length(_q) - 2)").alias("_key"), "_text", "_number"
        )
    if s.kind == "file":
        raw = read_jsonl(spark, s.path, s.time_field)
    else:
        raw = read_kafka(spark, s.bootstrap_servers, s.topic, s.time_field, s.group_id, s.auto_offset_reset or "latest")
    payload = F.col("payload")
    text = member_text(payload, field) if field else F.lit(None).cast("string")
    shown = member_json(payload, field) if field else F.lit(None).cast("string")
    # Booleans, arrays and objects are no numbers, though a string may spell one.
    number = F.when(shown.rlike(r'^["0-9+-]'), text_number(text)).otherwise(0.0)
    return raw.select("event_time", member_json(payload, by).alias("_key"), text.alias("_text"), number.alias("_number"))


def plan(spark: SparkSession, cfg: PipelineConfig) -> DataFrame:
    """The windowed aggregate that a configuration declares; ``key`` is JSON text, so that ``1`` and ``"1"`` differ."""
    cfg.validate()
    rows = _read(spark, cfg)
    field = {"count": None, "distinct": "_text"}.get(cfg.agg, "_number")
    return windowed_aggregate(rows, cfg.to_window(), "_key", cfg.agg, field, lateness_ms=parse_duration_ms(cfg.time.allowed_lateness))


def as_output(df: DataFrame) -> DataFrame:
    """The aggregate as one JSON ``payload`` a row, its key as the JSON value it is."""
    rest = sorted(c for c in df.columns if c not in ("key", "event_time"))
    parts = []
    for name in sorted([*rest, "key"]):
        shown = F.coalesce(F.col("key"), F.lit("null")) if name == "key" else F.coalesce(F.expr(f"substring(to_json(array(`{name}`)), 2, length(to_json(array(`{name}`))) - 2)"), F.lit("null"))
        parts.append(F.concat(F.lit(f'"{name}":'), shown))
    return df.withColumn("payload", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def build(spark: SparkSession, cfg: PipelineConfig, emit_time: str = "watermark", checkpoint: str | None = None) -> Pipeline:
    """A pipeline from a configuration.

    ``emit_time`` says what time a result carries: ``watermark``, the end of the input (36,500 days past its greatest
    time, as all windows close there), or ``window_end``, which gives partitions that follow the data.
    """
    result = plan(spark, cfg)
    pipeline, k = Pipeline(spark).source(result), cfg.sink

    def timed(df: DataFrame) -> DataFrame:
        out = as_output(df)
        if emit_time == "window_end" or df.isStreaming:
            return out.select(F.timestamp_millis("window_end_ms").alias("event_time"), "payload")
        mark = end_watermark(_read(spark, cfg))
        return out.crossJoin(F.broadcast(mark)).select(F.col("watermark").alias("event_time"), "payload")  # one row

    # Offsets are committed with each batch of a stream, so the commit interval is the longest time between two.
    commit = parse_duration_ms(cfg.source.commit_interval) if cfg.source.commit_interval else None
    every = {"processingTime": f"{commit} milliseconds"} if commit else {"processingTime": "0 seconds"}
    if k.kind == "parquet":
        by_date = k.partition_field in (None, "event_time")
        spec = ByDate(fmt=k.partition_format or "%Y-%m-%d") if by_date else ByField(k.partition_field)
        age = min(parse_duration_ms(k.max_age) if k.max_age else 300_000, commit or 300_000)
        sink = ParquetSink(k.out_dir, spec, k.max_rows or 1_000_000, age, k.max_bytes, k.compression)
        return pipeline.sink(lambda df: sink.start(timed(df), checkpoint) if df.isStreaming else sink.write(timed(df)))
    if k.kind == "file":
        if result.isStreaming:
            return pipeline.sink(lambda df: as_output(df).select("payload").writeStream.format("text").option("path", k.path).option("checkpointLocation", checkpoint).trigger(**every).start())
        return pipeline.sink(lambda df: write_json_lines(as_output(df).select(F.lit(None).cast("timestamp").alias("event_time"), "payload"), k.path))
    return pipeline.sink(lambda df: write_kafka(timed(df), k.bootstrap_servers, k.topic, None, k.acks or "all", checkpoint, every))
