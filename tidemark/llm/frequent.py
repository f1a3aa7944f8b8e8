"""Most frequent items of a column in bounded memory, by combinatorial group testing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship_package

#: Bits of an item's hash that the sketch spells out, the prime of its bucket hashes, and their factors (fixed values).
BITS = 40
PRIME = 1_099_511_627_791
FACTORS = (2_654_435, 1_640_531, 3_266_489, 668_265)
#: The widest sketch. Data that it cannot settle are counted exactly, but for the items that it rules out.
MOST_WIDTH = 1 << 15
#: Bits counted in one number, each in a lane of its own, and the rows that a lane can count.
LANES, LANE_BITS = 3, 17
ROWS_AT_ONCE = 1 << 16


@dataclass
class Sketch:
    """total[row, bucket] and ones[row, bucket, bit] of a whole column."""

    total: np.ndarray
    ones: np.ndarray

    @classmethod
    def empty(cls, width: int, depth: int) -> Sketch:
        return cls(np.zeros((depth, width), np.int64), np.zeros((depth, width, BITS), np.int64))

    @property
    def width(self) -> int:
        return self.total.shape[1]

    def buckets(self, items: np.ndarray) -> np.ndarray:
        """The bucket of each item's hash in each row."""
        return np.stack([(items * f + r) % PRIME % self.width for r, f in enumerate(FACTORS[: len(self.total)])])

    def add(self, items: np.ndarray) -> None:
        """Counts the hashes of some rows, fewer than a lane can count."""
        lane = np.array([sum(((n >> i) & 1) << (LANE_BITS * i) for i in range(LANES)) for n in range(1 << LANES)], dtype=np.float64)
        words = [lane[(items >> at) & ((1 << LANES) - 1)] for at in range(0, BITS, LANES)]
        for r, at in enumerate(self.buckets(items)):
            self.total[r] += np.bincount(at, minlength=self.width)
            for n, word in enumerate(words):
                sums = np.bincount(at, weights=word, minlength=self.width).astype(np.int64)
                for i in range(min(LANES, BITS - LANES * n)):
                    self.ones[r, :, LANES * n + i] += (sums >> (LANE_BITS * i)) & ((1 << LANE_BITS) - 1)

    def decode(self) -> np.ndarray:
        """Hashes of the items that outweigh the rest of some bucket."""
        bits = (2 * self.ones > self.total[..., None]).astype(np.int64)
        spelt = (bits << np.arange(BITS, dtype=np.int64)).sum(axis=2)
        rows, cols = np.nonzero(self.total)
        found = spelt[rows, cols]
        return np.unique(found[self.buckets(found)[rows, np.arange(len(found))] == cols])

    def estimate(self, items: np.ndarray) -> np.ndarray:
        """Upper bounds of the items' counts: the least counter that every row of theirs has to feed."""
        at = self.buckets(items)
        bits = (items[:, None] >> np.arange(BITS, dtype=np.int64)) & 1
        best = np.full(len(items), np.iinfo(np.int64).max)
        for r in range(len(self.total)):
            ones, total = self.ones[r, at[r]], self.total[r, at[r]]
            best = np.minimum(best, np.where(bits == 1, ones, total[:, None] - ones).min(axis=1, initial=np.iinfo(np.int64).max))
        return best

    def rest(self, items: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The totals less these items, whose exact counts are given."""
        rest = self.total.copy()
        for r, at in enumerate(self.buckets(items)):
            np.subtract.at(rest[r], at, counts)
        return rest

    def most_of_others(self, items: np.ndarray, counts: np.ndarray) -> int:
        """No item apart from these can have more rows than this."""
        rest = self.rest(items, counts)
        return int(rest.max(axis=1).min()) if rest.size else 0


def item_hash(item: Column) -> Column:
    """The 40-bit hash by which the sketch knows an item."""
    return F.pmod(F.xxhash64(item), F.lit(1 << BITS))


def build_sketch(items: DataFrame, item: str, width: int, depth: int = 3) -> Sketch:
    """The sketch of ``items[item]``; nulls do not count.

    Every task adds its rows into depth * width groups of 41 counters, so its memory (8 MB at the start, 32 MB at the
    widest) and what it sends are bounded; the sum of all tasks' counters, of the same size, is all that reaches the driver.
    """
    spark = items.sparkSession
    ship_package(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch.empty(width, depth)
        for batch in batches:
            hashes = np.asarray(batch.column(0))
            for lo in range(0, len(hashes), ROWS_AT_ONCE):
                sketch.add(hashes[lo : lo + ROWS_AT_ONCE])
        r, b = np.nonzero(sketch.total)
        columns = [r, b, sketch.total[r, b], *sketch.ones[r, b].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["r", "b", *names])

    names = ["total", *[f"b{i}" for i in range(BITS)]]
    hashes = items.filter(F.col(f"`{item}`").isNotNull()).select(item_hash(F.col(f"`{item}`")).alias("h"))
    fed = hashes.mapInArrow(work, ", ".join(f"{n} bigint" for n in ("r", "b", *names)))
    got = fed.groupBy("r", "b").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = Sketch.empty(width, depth)
    if len(got):
        r, b = got["r"].to_numpy(), got["b"].to_numpy()
        out.total[r, b] = got["total"].to_numpy()
        out.ones[r, b] = got[names[1:]].to_numpy()
    return out


def _possible(sketch: Sketch, rest: np.ndarray, least: int, spark) -> Column:
    """Whether an item, by its hash ``_h``, may have ``least`` rows or more: a test of its buckets' totals in a bit map."""
    out = F.lit(True)
    for r, f in enumerate(FACTORS[: len(sketch.total)]):
        packed = np.packbits(rest[r] >= least, bitorder="little")
        words = np.pad(packed, (0, -len(packed) % 8)).view(np.int64).tolist()
        bucket = F.pmod(F.pmod(F.col("_h") * f + r, F.lit(PRIME)), F.lit(sketch.width)).cast("int")
        word = F.element_at(F.lit(words).cast("array<bigint>"), F.shiftright(bucket, 6) + 1)
        out = out & (F.call_function("shiftright", word, bucket.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return out


def most_frequent(items: DataFrame, item: str, k: int, width: int = 2048, depth: int = 3) -> DataFrame:
    """The ``k`` most frequent values: the item, n (exact), n_estimate (from the sketch, never below n).

    Ties at the end go to the lesser value; nulls do not count; fewer than ``k`` distinct values give fewer rows.

    The sketch decodes the candidates, and one more pass counts only these. Then the sketch, less the counted items,
    bounds all values that were not decoded. While that bound reaches the k-th count, the sketch is built anew at four
    times the width. What ``MOST_WIDTH`` does not settle, such as ties of many rare values, is settled exactly: values
    whose buckets hold fewer rows than the k-th candidate are out, and the others are counted in a shuffle.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if item in ("n", "n_estimate"):
        raise ValueError("the item's column must not be called n or n_estimate")
    spark = items.sparkSession
    kind = items.schema[item].dataType.simpleString()
    schema = f"`{item}` {kind}, n bigint, n_estimate bigint"
    rows = items.select(F.col(f"`{item}`").alias("_item")).filter(F.col("_item").isNotNull()).withColumn("_h", item_hash(F.col("_item")))

    def rank(row) -> tuple:
        value = row["_item"]
        return -row["n"], value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value

    while True:
        sketch = build_sketch(rows, "_item", width, depth)
        found = sketch.decode()
        if not sketch.total.any():
            return spark.createDataFrame([], schema)
        guess = sketch.estimate(found) if len(found) else found
        candidates = spark.createDataFrame([(int(h), int(n)) for h, n in zip(found, guess)], "_h bigint, n_estimate bigint")
        # depth * MOST_WIDTH candidates at most.
        counted = rows.join(F.broadcast(candidates), "_h").groupBy("_item", "_h", "n_estimate").agg(F.count("*").alias("n"))
        # As many rows as candidates, but for values of one hash.
        got = counted.select("_item", "_h", "n", "n_estimate").collect()
        best = sorted(got, key=rank)[:k]
        rest = sketch.rest(np.array([r["_h"] for r in got], dtype=np.int64), np.array([r["n"] for r in got], dtype=np.int64))
        others = int(rest.max(axis=1).min())
        if others == 0 or len(best) == k and best[-1]["n"] > others:
            return spark.createDataFrame([(r["_item"], r["n"], r["n_estimate"]) for r in best], schema)
        if width * 4 > MOST_WIDTH:
            break
        width *= 4
    # Candidates take part as they are; of the others, those that can still reach the k-th count.
    least = best[-1]["n"] if len(best) == k else 1
    apart = rows.join(F.broadcast(candidates.select("_h")), "_h", "left_anti").filter(_possible(sketch, rest, max(1, least), spark))
    every = apart.groupBy("_item").agg(F.count("*").alias("n"), F.count("*").alias("n_estimate"))
    known = spark.createDataFrame([(r["_item"], r["n"], r["n_estimate"]) for r in best], f"_item {kind}, n bigint, n_estimate bigint")
    top = every.unionByName(known).orderBy(F.desc("n"), "_item").limit(k)
    return top.select(F.col("_item").alias(item), "n", "n_estimate")
