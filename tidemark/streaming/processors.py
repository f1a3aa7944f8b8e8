"""Stateful operators for streams, where Spark's own windows follow another rule.

All need the RocksDB state store, see ``use_rocksdb``. They are Python processors, so slower than built-in windows; take
them where the rule itself is wanted: late per record, sessions in order of arrival, a count at every row, own folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.columns import epoch_ms
from tidemark.operators.windows import Sliding, Tumbling
from tidemark.session import ship_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keeps streaming state in RocksDB, with changelog checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _truncated(value: int, step: int) -> int:
    return int(value / step) * step if abs(value) < 1 << 53 else (value // step if value >= 0 else -(-value // step)) * step


def starts_of(ms: int, window: Tumbling | Sliding) -> list[int]:
    """The window starts of a time, by the same rule as the batch operators."""
    if isinstance(window, Tumbling):
        return [_truncated(ms, window.size_ms)]
    anchor = _truncated(ms, window.slide_ms)
    starts = (anchor - j * window.slide_ms for j in range(window.overlap))
    return [s for s in starts if s <= ms < s + window.size_ms]


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a key in a batch by arrival. They come in parts, of which each would be in order only by itself."""
    parts = [part for part in rows if len(part)]
    if parts:
        yield pd.concat(parts).sort_values("arrival", kind="stable")


class _Windows(StatefulProcessor):
    """A fold per key and window; rows behind the watermark on arrival are dropped one by one."""

    def __init__(self, window: Tumbling | Sliding, init: Any, step: Callable[[Any, Any], Any], kind: str):
        self.window, self.start, self.step, self.kind = window, init, step, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start bigint", f"state {self.kind}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        behind = timerValues.getCurrentWatermarkInMs()
        for part in _in_order(rows):
            for ms, value in part[["ms", "value"]].itertuples(index=False):
                if ms <= behind:
                    continue
                for start in starts_of(int(ms), self.window):
                    held = self.open.getValue((start,)) if self.open.containsKey((start,)) else (self.start,)
                    if held == (self.start,) and not self.open.containsKey((start,)):
                        self.handle.registerTimer(start + self.window.size_ms - 1)
                    self.open.updateValue((start,), (self.step(held[0], value),))
        yield pd.DataFrame(columns=["window_start_ms", "window_end_ms", "key", "state"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() + 1 - self.window.size_ms
        if self.open.containsKey((start,)):
            state = self.open.getValue((start,))[0]
            self.open.removeKey((start,))
            yield pd.DataFrame({"window_start_ms": [start], "window_end_ms": [start + self.window.size_ms], "key": [key[0]], "state": [state]})

    def close(self) -> None:
        pass


class _ArrivalSessions(StatefulProcessor):
    """Sessions by the last row that arrived, so an early row neither opens nor lowers one."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "start bigint, last bigint, n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        behind = timerValues.getCurrentWatermarkInMs()
        held = self.now.get() if self.now.exists() else None
        out = []
        for part in _in_order(rows):
            for ms in part["ms"]:
                ms = int(ms)
                if ms <= behind:
                    continue
                if held is not None and ms - held[1] <= self.gap:
                    held = (held[0], ms, held[2] + 1)
                else:
                    if held is not None:
                        out.append((held[0], held[1] + self.gap, key[0], held[2]))
                    held = (ms, ms, 1)
        if held is not None:
            self.now.update(held)
            self.handle.registerTimer(held[1] + self.gap - 1)
        yield pd.DataFrame(out, columns=["window_start_ms", "window_end_ms", "key", "count"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.now.exists():
            start, last, n = self.now.get()
            if last + self.gap - 1 <= expiredTimerInfo.getExpiryTimeInMs():
                self.now.clear()
                yield pd.DataFrame({"window_start_ms": [start], "window_end_ms": [last + self.gap], "key": [key[0]], "count": [n]})

    def close(self) -> None:
        pass


class _RunningCount(StatefulProcessor):
    """A row's number within its key and bucket, at every row."""

    def __init__(self, size_ms: int):
        self.size = size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "start bigint", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in _in_order(rows):
            out = []
            for ms in part["ms"]:
                start = _truncated(int(ms), self.size)
                n = (self.counts.getValue((start,))[0] if self.counts.containsKey((start,)) else 0) + 1
                self.counts.updateValue((start,), (n,))
                out.append((start, key[0], n))
            yield pd.DataFrame(out, columns=["window_start_ms", "key", "count"])

    def close(self) -> None:
        pass


def _input(df: DataFrame, key: str, at: str, lateness_ms: int, value: str | None, order: str | None) -> DataFrame:
    ship_package(df.sparkSession)
    rows = df.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")).alias("key"), epoch_ms(df, at).alias("ms"),
        (F.col(value) if value else F.lit(1)).alias("value"), (F.col(order) if order else epoch_ms(df, at)).alias("arrival"),
    ).filter("ms IS NOT NULL")
    # Spark itself drops rows of stateful steps at the watermark or before it. One ms more makes that: before it; the
    # timers are one ms early for the same reason.
    return rows.withColumn("_at", F.timestamp_millis("ms")).withWatermark("_at", f"{lateness_ms + 1} milliseconds")


def strict_windows(df: DataFrame, window: Tumbling | Sliding, key: str, init: Any, step: Callable[[Any, Any], Any], kind: str, value: str | None = None, at: str = "event_time", lateness_ms: int = 0, order: str | None = None) -> DataFrame:
    """A fold per window and key of a stream: window_start_ms, window_end_ms, key, state.

    A row is dropped if it is behind the watermark of its batch, even where its window is still open. Windows close,
    and free their state, when the watermark passes their end. A null key is the key ``null``. Rows are folded by
    ``order``, by event time where none is given; those of a key in one batch are ordered in memory.
    """
    rows = _input(df, key, at, lateness_ms, value, order)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Windows(window, init, step, kind), outputStructType=f"window_start_ms bigint, window_end_ms bigint, key string, state {kind}",
        outputMode="Append", timeMode="EventTime",
    )


def arrival_sessions(df: DataFrame, gap_ms: int, key: str, order: str, at: str = "event_time", lateness_ms: int = 0) -> DataFrame:
    """Sessions of a stream that depend on the order of arrival: window_start_ms, window_end_ms, key, count.

    ``order`` is the column with the order of arrival, such as an offset. The rows of a key in one batch are ordered in memory.
    """
    rows = _input(df, key, at, lateness_ms, None, order)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_ArrivalSessions(gap_ms), outputStructType="window_start_ms bigint, window_end_ms bigint, key string, count bigint",
        outputMode="Append", timeMode="EventTime",
    )


def running_counts(df: DataFrame, key: str, at: str = "event_time", size_ms: int = 60_000, order: str | None = None) -> DataFrame:
    """The running count at every row of a stream: window_start_ms, key, count. Counts are never evicted."""
    rows = _input(df, key, at, 0, None, order)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_RunningCount(size_ms), outputStructType="window_start_ms bigint, key string, count bigint", outputMode="Append", timeMode="None"
    )
