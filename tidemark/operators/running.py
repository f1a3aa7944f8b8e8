"""Counts that go on from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import epoch_ms, floor_div
from tidemark.operators.windows import bucket_start

MINUTE_MS = 60_000


def running_count(df: DataFrame, key: str, order: Column, at: str = "event_time", size_ms: int = MINUTE_MS, block: int = 100_000) -> DataFrame:
    """The number of rows of a key in its minute so far, at every row: the row's columns, window_start_ms, key, count.

    ``order`` is the order of arrival, a whole number without ties; rows with ties count in any order. A null key is a
    key; rows with a null time are left out. The count runs within ``block`` consecutive order values and goes on from
    the sum of the blocks before, so that a minute in which one key holds most rows is not one task's work.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), epoch_ms(df, at).alias("_ms"), order.cast("bigint").alias("_order")).filter(F.col("_ms").isNotNull())
    rows = rows.withColumn("window_start_ms", bucket_start(F.col("_ms"), size_ms)).withColumn("_block", floor_div(F.col("_order"), block))
    group = ["window_start_ms", "key"]
    sums = rows.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *[F.col(c).alias(f"_b_{c}") for c in group], F.col("_block").alias("_b_block"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry")
    )
    inside = Window.partitionBy(*group, "_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_n", F.count("*").over(inside))
    same = (F.col("window_start_ms") == F.col("_b_window_start_ms")) & F.col("key").eqNullSafe(F.col("_b_key")) & (F.col("_block") == F.col("_b_block"))
    return counted.join(carried, same).select(
        F.col("_order").alias("arrival"), F.col("_ms").alias("event_ms"), "window_start_ms", "key", (F.col("_n") + F.col("_carry")).alias("count")
    )
