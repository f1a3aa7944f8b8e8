"""Per-key results, alone and through joins, whose cost does not follow the largest key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, keys: dict[str, Column], value: Column | None = None, at_ms: Column | None = None) -> DataFrame:
    """Compact states per key: n, n_value, total, first_ms, last_ms.

    The states combine algebraically, so every task sends one row per key it saw, and a hot key costs no task more than
    any other key. Null keys form no group. ``n_value`` counts values that are not null; ``total`` is null without any.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    rows = df.select(
        *[c.alias(n) for n, c in zip(names, keys.values())],
        (F.lit(None) if value is None else value).cast("double").alias("_value"),
        (F.lit(None) if at_ms is None else at_ms).cast("bigint").alias("_ms"),
    )
    for name in names:
        rows = rows.filter(F.col(name).isNotNull())
    states = rows.groupBy(*names).agg(
        F.count("*").alias("n"),
        F.count("_value").alias("n_value"),
        F.sum("_value").alias("total"),
        F.min("_ms").alias("first_ms"),
        F.max("_ms").alias("last_ms"),
    )
    return states.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n", "n_value", "total", "first_ms", "last_ms")


#: States of one join key are spread over this many tasks.
SALT = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner", salt: int = SALT) -> DataFrame:
    """``left JOIN right``, each key spread over ``salt`` groups by ``spread`` of the left row.

    ``right`` is sent ``salt`` times; it must have a row per key at most, or the left rows multiply as in any join.
    """
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    # Never null, and written so that Spark sees it: a null check would keep it from sharing a shuffle with ``right``.
    one = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.lit(salt)).cast("int"), F.lit(0)))
    return one.join(many, [*on, "_salt"], how).drop("_salt")


def eager_join_aggregate(left: DataFrame, right: DataFrame, on: list[str], group: list[str]) -> DataFrame:
    """The aggregates of ``left JOIN right ON on GROUP BY group``, without ever forming the joined rows.

    Both inputs are states as from ``key_states``: left's keys are ``on`` and ``group``, right's keys are ``on``. Each
    joined pair of states stands for n_left * n_right joined rows, so counts multiply and sums scale:

    pairs: number of joined rows; left_total, right_total: sums of either side's values over them; left_n: left rows
    with a partner, each once; right_n: right rows met per group; first_ms, last_ms: of the left rows.
    Keys without a partner form no group, as in the join. Columns other than those named must not be in the states.
    A join key with many groups is spread over ``SALT`` tasks by the group.
    """
    met = right.select(*on, F.col("n").alias("_n"), F.col("total").alias("_total"))
    within = [g for g in group if g not in on]
    joined = salted_join(left, met, on, F.struct(*within)) if within else left.join(met, on, "inner")
    return joined.groupBy(*group).agg(
        F.sum(F.col("n") * F.col("_n")).alias("pairs"),
        F.sum(F.col("total") * F.col("_n")).alias("left_total"),
        F.sum(F.col("_total") * F.col("n")).alias("right_total"),
        F.sum("n").alias("left_n"),
        F.sum("_n").alias("right_n"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
    )


def heavy_keys(df: DataFrame, key: Column, share: int, name: str = "key", shards: int = 64) -> DataFrame:
    """``name``, left_n (its rows) and right_n (all rows) of keys that hold at least one ``share``-th of all rows, rows without a key included in the whole.

    This is an eager join of the table with itself on the shard of a key, where each shard of the right side stands for
    the whole table: the states per key, rows without a key being one of them, are rolled up to one state, of which
    every shard gets a copy. One scan and one shuffle feed both sides; no row of the table is joined.
    """
    if share <= 0 or shards <= 0:
        raise ValueError("share and shards must be positive")
    rows = df.select(key.alias("_key"))
    states = rows.groupBy("_key").agg(F.count("*").alias("n"), F.count("_key").alias("_keyed"))
    # Both sides name the same columns of the states, and keys that are null go by a count, which Spark cannot move
    # below the aggregate: so the second use of the states takes the shuffle of the first.
    keyed = states.filter("_keyed > 0").withColumn("_shard", F.coalesce(F.pmod(F.xxhash64("_key"), F.lit(shards)).cast("int"), F.lit(0)))
    whole = states.groupBy().agg(F.sum("n").alias("n"), F.sum("_keyed").alias("_keyed")).filter("_keyed > 0")
    each = whole.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), F.col("n").alias("_n"))
    met = keyed.select("_shard", F.col("_key").alias(name), "n").join(each, "_shard")
    return met.filter(F.col("n") * share >= F.col("_n")).select(name, F.col("n").alias("left_n"), F.col("_n").alias("right_n"))
