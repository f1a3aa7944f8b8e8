"""Sessions that depend on the order in which rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import epoch_ms, floor_div


def arrival_sessions(df: DataFrame, gap_ms: int, key: str, order: Column, at: str = "event_time", block: int = 100_000) -> DataFrame:
    """window_start_ms, window_end_ms, key, count: a row goes on with its key's session if its time is at most ``gap_ms``
    past that of the row that arrived before it, also if it is earlier.

    A session starts at its first row's time and ends ``gap_ms`` past its last row's, whatever came in between; so the
    order of arrival, a whole number without ties, decides. A null key is the key ``null``; null times are left out.

    Rows are compared within ``block`` consecutive order values. The first and the last session of a key in a block may
    reach into others; these, two a block, are joined per key, and all others are finished where they are.
    """
    if gap_ms < 0 or block <= 0:
        raise ValueError("gap_ms must not be negative and block must be positive")
    rows = df.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")).alias("key"), epoch_ms(df, at).alias("ms"), order.cast("bigint").alias("o")
    ).filter(F.col("ms").isNotNull())
    rows = rows.withColumn("b", floor_div(F.col("o"), block))
    inside = Window.partitionBy("key", "b").orderBy("o")
    last = F.lag("ms").over(inside)
    cut = rows.withColumn("new", F.when(last.isNull(), 0).otherwise((F.col("ms") - last > gap_ms).cast("int")))
    cut = cut.withColumn("no", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut.groupBy("key", "b", "no").agg(
        F.min(F.struct("o", "ms"))["ms"].alias("start"), F.max(F.struct("o", "ms"))["ms"].alias("end"), F.count("*").alias("n")
    )
    # A block's numbers start at 0; its greatest is the last part's.
    parts = parts.withColumn("top", F.max("no").over(Window.partitionBy("key", "b")))
    edge = (F.col("no") == 0) | (F.col("no") == F.col("top"))
    parts = parts.withColumn("route", F.when(~edge, F.struct("b", "no")))
    along = Window.partitionBy("key", "route").orderBy("b", "no")
    before = F.lag("end").over(along)
    joined = before.isNotNull() & (F.col("no") == 0) & (F.col("start") - before <= gap_ms)
    parts = parts.withColumn("new", (~joined).cast("int"))
    parts = parts.withColumn("session", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    out = parts.groupBy("key", "route", "session").agg(
        F.min(F.struct("b", "no", "start"))["start"].alias("window_start_ms"), F.max(F.struct("b", "no", "end"))["end"].alias("end"), F.sum("n").alias("count")
    )
    return out.select("window_start_ms", (F.col("end") + gap_ms).alias("window_end_ms"), "key", "count")
