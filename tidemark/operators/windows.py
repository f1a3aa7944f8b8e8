"""Windowed aggregates per key: tumbling, sliding and session windows by count, sum, average and distinct values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import epoch_ms, floor_div
from tidemark.functions.payload import as_number, as_text, finite
from tidemark.operators.sessionize import HOUR_MS, sessionize

AGGREGATES = ("count", "sum", "avg", "distinct")
OUTPUT = {"count": "count", "sum": "sum", "avg": "avg", "distinct": "distinct_count"}


def _positive(**values: int) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class Tumbling:
    size_ms: int

    def __post_init__(self) -> None:
        _positive(size_ms=self.size_ms)

    @classmethod
    def minutes(cls, n: int) -> Tumbling:
        return cls(n * 60_000)


@dataclass(frozen=True)
class Sliding:
    size_ms: int
    slide_ms: int

    def __post_init__(self) -> None:
        _positive(size_ms=self.size_ms, slide_ms=self.slide_ms)

    @property
    def overlap(self) -> int:
        """Windows that a time can be in: whole slides in a size; none if the slide is the longer."""
        return self.size_ms // self.slide_ms


@dataclass(frozen=True)
class Session:
    gap_ms: int

    def __post_init__(self) -> None:
        _positive(gap_ms=self.gap_ms)


Window = Tumbling | Sliding | Session


def bucket_start(ms: Column, size_ms: int) -> Column:
    """The multiple of ``size_ms`` next to a time, toward zero."""
    size = F.lit(size_ms).cast("bigint")
    return F.call_function("div", ms, size) * size


def sliding_starts(ms: Column, window: Sliding) -> Column:
    """Starts of the windows that hold a time: multiples of the slide, as many as whole slides fit, that begin by then."""
    if window.overlap == 0:
        return F.array().cast("array<bigint>")
    anchor = bucket_start(ms, window.slide_ms)
    steps = F.array(*[F.lit(j * window.slide_ms).cast("bigint") for j in range(window.overlap)])
    return F.filter(F.transform(steps, lambda s: anchor - s), lambda s: (s <= ms) & (ms < s + window.size_ms))


def _final(agg: str) -> Column:
    if agg == "count":
        return F.sum("_n").alias("count")
    if agg == "sum":
        return finite(F.sum("_v")).alias("sum")
    if agg == "avg":
        return finite(F.sum("_v") / F.sum("_n")).alias("avg")
    return F.count_distinct("_v").alias("distinct_count")


def _batch(rows: DataFrame, window: Window, agg: str) -> DataFrame:
    """``rows`` has _k, _ms and _v (a number, or a text for distinct)."""
    if isinstance(window, Session):
        return _batch_sessions(rows, window, agg)
    size = window.size_ms
    rows = rows.withColumn("_n", F.lit(1).cast("bigint"))
    if isinstance(window, Tumbling):
        placed = rows.withColumn("_start", bucket_start(F.col("_ms"), size))
    elif window.overlap == 0:
        placed = rows.filter(F.lit(False)).withColumn("_start", F.col("_ms"))
    elif size % window.slide_ms:
        placed = rows.withColumn("_start", F.explode(sliding_starts(F.col("_ms"), window)))
    else:
        # Rows of one slide share their windows, but for a negative time between two slides, which misses the first.
        pane = rows.withColumn("_pane", bucket_start(F.col("_ms"), window.slide_ms))
        pane = pane.withColumn("_late", (F.col("_pane") > F.col("_ms")).cast("int"))
        if agg == "distinct":
            pane = pane.select("_k", "_pane", "_late", "_v", "_n").distinct()
        else:
            pane = pane.groupBy("_k", "_pane", "_late").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
        steps = F.sequence(F.col("_late"), F.lit(window.overlap - 1))
        if window.overlap == 1:
            pane = pane.filter("_late = 0")
            steps = F.array(F.lit(0))
        placed = pane.withColumn("_step", F.explode(steps))
        placed = placed.withColumn("_start", F.col("_pane") - F.col("_step") * F.lit(window.slide_ms).cast("bigint"))
    out = placed.groupBy("_start", "_k").agg(_final(agg))
    return out.select(F.col("_start").alias("window_start_ms"), (F.col("_start") + size).alias("window_end_ms"), F.col("_k").alias("key"), OUTPUT[agg])


def _batch_sessions(rows: DataFrame, window: Session, agg: str) -> DataFrame:
    if agg == "distinct":
        # Rows meet their session in the time buckets it reaches into, so that a key is not one task here either.
        spans = sessionize(rows, {"_key": F.struct("_k")}, F.col("_ms"), window.gap_ms)
        reach = F.sequence(floor_div(F.col("first_ms"), HOUR_MS), floor_div(F.col("last_ms"), HOUR_MS))
        spans = spans.select(F.col("_key._k").alias("_sk"), "first_ms", "last_ms", F.explode(reach).alias("_sb"))
        seen = rows.select("_k", "_ms", "_v").distinct().withColumn("_bucket", floor_div(F.col("_ms"), HOUR_MS))
        same = F.col("_k").eqNullSafe(F.col("_sk")) & (F.col("_bucket") == F.col("_sb")) & F.col("_ms").between(F.col("first_ms"), F.col("last_ms"))
        out = seen.join(spans, same).groupBy("_k", "first_ms", "last_ms").agg(F.count_distinct("_v").alias("distinct_count"))
        end = (F.col("last_ms") + window.gap_ms).alias("window_end_ms")
        return out.select(F.col("first_ms").alias("window_start_ms"), end, F.col("_k").alias("key"), "distinct_count")
    # A null key is a key here: inside a struct it is not left out.
    found = sessionize(rows, {"_key": F.struct("_k")}, F.col("_ms"), window.gap_ms, value=None if agg == "count" else F.col("_v"))
    shown = F.col("n_rows") if agg == "count" else finite(F.col("total") / (F.col("n_rows") if agg == "avg" else 1))
    return found.select(
        F.col("first_ms").alias("window_start_ms"),
        (F.col("last_ms") + window.gap_ms).alias("window_end_ms"),
        F.col("_key._k").alias("key"),
        shown.alias(OUTPUT[agg]),
    )


def _stream(rows: DataFrame, window: Window, agg: str, lateness_ms: int) -> DataFrame:
    timed = rows.withColumn("_at", F.timestamp_millis("_ms")).withWatermark("_at", f"{lateness_ms} milliseconds")
    if isinstance(window, Session):
        w = F.session_window("_at", f"{window.gap_ms} milliseconds")
    elif isinstance(window, Tumbling):
        w = F.window("_at", f"{window.size_ms} milliseconds")
    elif window.overlap == 0:
        w, timed = F.window("_at", f"{window.size_ms} milliseconds"), timed.filter(F.lit(False))
    else:
        w = F.window("_at", f"{window.size_ms} milliseconds", f"{window.slide_ms} milliseconds")
    timed = timed.withColumn("_w", w)
    if isinstance(window, Sliding) and window.overlap and window.size_ms % window.slide_ms:
        first = bucket_start(F.col("_ms"), window.slide_ms) - (window.overlap - 1) * window.slide_ms
        timed = timed.filter(F.unix_millis("_w.start") >= first)
    total = {
        "count": F.count("*").alias("count"),
        "sum": F.sum("_v").alias("sum"),
        "avg": (F.sum("_v") / F.count("*")).alias("avg"),
        "distinct": F.size(F.collect_set("_v")).cast("bigint").alias("distinct_count"),
    }[agg]
    out = timed.groupBy("_w", "_k").agg(total)
    value = F.col(OUTPUT[agg])
    return out.select(
        F.unix_millis("_w.start").alias("window_start_ms"),
        F.unix_millis("_w.end").alias("window_end_ms"),
        F.col("_k").alias("key"),
        (finite(value) if agg in ("sum", "avg") else value).alias(OUTPUT[agg]),
    )


def windowed_aggregate(df: DataFrame, window: Window, key: str, agg: str = "count", field: str | None = None, at: str = "event_time", lateness_ms: int = 0) -> DataFrame:
    """Per window and key: window_start_ms, window_end_ms, key and count, sum, avg or distinct_count.

    ``field`` is what is summed, averaged or told apart. Values that are null or no number count as 0.0 in sums and in
    averages, which divide by all rows; among distinct values null is one, and ``1`` and ``"1"`` are one. A sum that is
    not finite is null. A null key is a group; rows with a null time are left out; an empty table gives no rows.

    On a batch frame every window is final. Sliding windows are made of panes, one slide long, so a row is counted once
    and not once per window; sessions work within time buckets, as in ``sessionize``. On a streaming frame the windows
    close behind the watermark, ``lateness_ms`` (not negative) after the greatest time; use append mode.
    """
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    if agg != "count" and field is None:
        raise ValueError(f"{agg} needs a field")
    value = F.lit(0.0) if agg == "count" else (as_text(df, field) if agg == "distinct" else as_number(df, field))
    rows = df.select(F.col(f"`{key}`").alias("_k"), epoch_ms(df, at).alias("_ms"), value.alias("_v")).filter(F.col("_ms").isNotNull())
    if df.isStreaming:
        return _stream(rows, window, agg, max(0, lateness_ms))
    return _batch(rows, window, agg)
