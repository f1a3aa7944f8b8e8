"""User-defined folds per window."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import epoch_ms
from tidemark.operators.windows import Sliding, Tumbling, bucket_start, sliding_starts
from tidemark.session import ship_package


def assign_windows(df: DataFrame, window: Tumbling | Sliding, at: str = "event_time") -> DataFrame:
    """A row per row and window that holds its time, with window_start_ms and window_end_ms; null times are in none."""
    ms = epoch_ms(df, at)
    starts = sliding_starts(ms, window) if isinstance(window, Sliding) else F.array(bucket_start(ms, window.size_ms))
    out = df.filter(F.col(at).isNotNull()).withColumn("window_start_ms", F.explode(starts))
    return out.withColumn("window_end_ms", F.col("window_start_ms") + window.size_ms)


def fold(df: DataFrame, window: Tumbling | Sliding, init: Column, step: Callable[[Column, Column], Column], value: str, order: str, at: str = "event_time") -> DataFrame:
    """window_start_ms, window_end_ms, state: ``step`` over each window's values in ``order``, starting with ``init``.

    The step is a column expression, so it runs inside code generation. A fold has no merge rule, so a window's values
    meet in one task: a window of ``size_ms`` has to fit one. Where the fold can be merged, use ``fold_merge``.
    """
    placed = assign_windows(df, window, at)
    listed = placed.groupBy("window_start_ms", "window_end_ms").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_l"))
    return listed.select("window_start_ms", "window_end_ms", F.reduce("_l", init, lambda acc, x: step(acc, x["v"])).alias("state"))


def fold_merge(df: DataFrame, window: Tumbling | Sliding, state: Column, at: str = "event_time") -> DataFrame:
    """As ``fold`` for a state that is a built-in aggregate such as ``F.sum``: partial states merge before they move."""
    return assign_windows(df, window, at).groupBy("window_start_ms", "window_end_ms").agg(state.alias("state"))


def fold_python(df: DataFrame, window: Tumbling | Sliding, fn: Callable[[pd.DataFrame], object], kind: str, order: str, at: str = "event_time") -> DataFrame:
    """As ``fold`` with a Python function over a window's rows, sorted by ``order``; ``kind`` is the state's type."""
    ship_package(df.sparkSession)
    placed = assign_windows(df, window, at)

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = fn(rows.sort_values(order))
        return pd.DataFrame({"window_start_ms": [key[0]], "window_end_ms": [key[1]], "state": [state]})

    return placed.groupBy("window_start_ms", "window_end_ms").applyInPandas(work, f"window_start_ms bigint, window_end_ms bigint, state {kind}")
