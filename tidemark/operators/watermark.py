"""Watermarks over recorded arrivals: what was known when, and what came too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import epoch_ms, floor_div

#: How far a finished file's watermark lies past its greatest time (a fixed value, in days).
END_DAYS = 36_500


def _carried(tops: DataFrame, group: int) -> DataFrame:
    """For blocks with their greatest time, _block and _top: _b, the block, and _carry, the greatest of all blocks before."""
    rows = tops.withColumn("_group", floor_div(F.col("_block"), group))
    groups = rows.groupBy("_group").agg(F.max("_top").alias("_top"))
    above = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    upper = groups.select(F.col("_group").alias("_g"), "_top").withColumn("_upper", F.max("_top").over(above)).drop("_top")
    before = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.max("_top").over(before))
    out = inside.join(upper, F.col("_group").eqNullSafe(F.col("_g")))
    return out.select(F.col("_block").alias("_b"), F.greatest("_inside", "_upper").alias("_carry"))


def with_watermark_ms(df: DataFrame, order: Column, at: str = "event_time", lateness_ms: int = 0, block: int = 100_000) -> DataFrame:
    """``df`` with watermark_ms, the greatest time up to a row less the lateness, and prior_ms, the same before the row.

    ``order`` is the order of arrival, a whole number without ties. Rows with a null time advance nothing; before the
    first time both are null. Columns of these two names are replaced. The maximum runs within ``block`` consecutive order values and from the greatest of the
    blocks before. These are carried in two levels, so that the one task that orders all of the upper level has a row per
    ``block`` times ``block`` rows.
    """
    kept = [c for c in df.columns if c not in ("watermark_ms", "prior_ms")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), epoch_ms(df, at).alias("_ms"), order.cast("bigint").alias("_order"))
    rows = rows.withColumn("_block", floor_div(F.col("_order"), block))
    tops = rows.groupBy("_block").agg(F.max("_ms").alias("_top"))
    carried = _carried(tops, block)
    inside = Window.partitionBy("_block").orderBy("_order")
    rows = rows.withColumn("_now", F.max("_ms").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_prior", F.max("_ms").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    out = rows.join(carried, F.col("_block").eqNullSafe(F.col("_b")))
    return out.select("_row.*", (F.greatest("_now", "_carry") - lateness_ms).alias("watermark_ms"), (F.greatest("_prior", "_carry") - lateness_ms).alias("prior_ms"))


def on_time(df: DataFrame, order: Column, at: str = "event_time", lateness_ms: int = 0) -> DataFrame:
    """The rows that are not behind the watermark when they arrive; one at the watermark stays, as does a null time."""
    marked = with_watermark_ms(df, order, at, lateness_ms)
    late = epoch_ms(marked, at) < F.col("prior_ms")
    return marked.filter(~F.coalesce(late, F.lit(False))).drop("watermark_ms", "prior_ms")


def end_watermark(df: DataFrame, at: str = "event_time") -> DataFrame:
    """One row: the watermark of the whole input's end, past every window; null for an input without times."""
    return df.select(F.max(at).alias("_t")).select((F.col("_t") + F.make_dt_interval(F.lit(END_DAYS))).alias("watermark"))
