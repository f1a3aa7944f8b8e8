"""Sessions of activity per key, separated by silence longer than a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import floor_div

HOUR_MS = 3_600_000


def _numbered(rows: DataFrame, by: Sequence[str], start: str, end: str, gap_ms: int) -> DataFrame:
    """``rows`` with ``_no``, counting up within ``by`` wherever ``start`` is over ``gap_ms`` past the last ``end``."""
    order = Window.partitionBy(*by).orderBy(start)
    last = F.lag(end).over(order)
    flagged = rows.withColumn("_new", F.when(last.isNull() | (F.col(start) - last > gap_ms), 1).otherwise(0))
    return flagged.withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessionize(df: DataFrame, keys: dict[str, Column], at_ms: Column, gap_ms: int, bucket_ms: int = HOUR_MS, value: Column | None = None) -> DataFrame:
    """One row per key and session: the key columns, first_ms, last_ms, n_rows; with ``value``, its sum as total.

    Neighbours in time share a session when they differ by ``gap_ms`` or less. Rows with a null key column or a null
    time have no session; ties and repeated rows count in ``n_rows``; an empty table gives no rows; columns other than
    those named are not read, so their names cannot clash.

    Rows are first counted per key and millisecond, before they move. The lag and the running sum then work within a
    key's time bucket, which holds ``bucket_ms`` distinct times at most, however many rows the key has. Only sessions
    within ``gap_ms`` of a bucket's edge can go on in the next bucket; these, two a bucket, are stitched per key.
    """
    if gap_ms < 0 or bucket_ms <= 0:
        raise ValueError("gap_ms must not be negative and bucket_ms must be positive")
    names = [f"_key{i}" for i in range(len(keys))]
    summed = [] if value is None else [F.sum("_v").alias("_v")]
    rows = df.select(*[c.alias(n) for n, c in zip(names, keys.values())], at_ms.alias("_ms"), *([] if value is None else [value.alias("_v")]))
    for name in (*names, "_ms"):
        rows = rows.filter(F.col(name).isNotNull())
    counted = rows.groupBy(*names, "_ms").agg(F.count("*").alias("_n"), *summed)
    bucketed = counted.withColumn("_bucket", floor_div(F.col("_ms"), bucket_ms))
    within = [*names, "_bucket"]
    local = (
        _numbered(bucketed, within, "_ms", "_ms", gap_ms)
        .groupBy(*within, "_no")
        .agg(F.min("_ms").alias("_first"), F.max("_ms").alias("_last"), F.sum("_n").alias("_n"), *summed)
    )
    low = F.col("_bucket") * bucket_ms
    touches = (F.col("_first") - (low - 1) <= gap_ms) | (low + bucket_ms - F.col("_last") <= gap_ms)
    # Closed sessions keep a group of their own; the open ones of a key meet in group null.
    routed = local.withColumn("_route", F.when(~touches, F.col("_first")))
    stitched = _numbered(routed, [*names, "_route"], "_first", "_last", gap_ms)
    out = stitched.groupBy(*names, "_route", "_no").agg(
        F.min("_first").alias("first_ms"), F.max("_last").alias("last_ms"), F.sum("_n").alias("n_rows"), *summed
    )
    total = [] if value is None else [F.col("_v").alias("total")]
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "first_ms", "last_ms", "n_rows", *total)
