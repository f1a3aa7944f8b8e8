"""Exactly one copy of every message that was delivered at least once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import floor_div
from tidemark.session import partitions, ship_package

#: Bits per identifier and probes of a filter: about 1 % of new identifiers are taken for possible repeats.
BITS_PER_ID = 10
PROBES = 7
#: Filters that share a summary filter, and summaries that share one of the next level.
GROUP = 32
#: Bytes of input, as Spark estimates them, whose identifiers make one shard: some 2 million, in about 100 MB of a task.
SHARD_BYTES = 64 << 20


class BloomFilter:
    """Set of 64-bit hashes with false positives only, over numpy arrays."""

    def __init__(self, expected: int, bits_per_id: int = BITS_PER_ID, probes: int = PROBES):
        self.words = np.zeros(max(1, -(-max(1, expected) * bits_per_id // 64)), dtype=np.uint64)
        self.probes = probes

    def _positions(self, hashes: np.ndarray) -> np.ndarray:
        # Mixed anew: all hashes of a shard agree in what the shard was chosen by.
        h = hashes.astype(np.int64, copy=False).view(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        h = (h ^ (h >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        step = (h >> np.uint64(33)) | np.uint64(1)
        at = np.arange(self.probes, dtype=np.uint64)[:, None]
        return ((h & np.uint64(0xFFFFFFFF))[None, :] + at * step[None, :]) % np.uint64(64 * len(self.words))

    def add(self, hashes: np.ndarray) -> None:
        pos = self._positions(hashes).ravel()
        np.bitwise_or.at(self.words, (pos >> np.uint64(6)).astype(np.int64), np.uint64(1) << (pos & np.uint64(63)))

    def might_contain(self, hashes: np.ndarray) -> np.ndarray:
        pos = self._positions(hashes)
        bits = self.words[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63))
        return (bits & np.uint64(1)).all(axis=0)


@dataclass
class Stored:
    """The identifiers of one time bucket, by hash, with their filter."""

    ids: pa.RecordBatch
    hashes: np.ndarray
    order: np.ndarray
    bloom: BloomFilter

    @classmethod
    def of(cls, ids: pa.RecordBatch, hashes: np.ndarray) -> Stored:
        bloom = BloomFilter(len(hashes))
        bloom.add(hashes)
        order = np.argsort(hashes, kind="stable")
        return cls(ids, hashes[order], order, bloom)

    def has(self, ids: pa.RecordBatch, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the identifiers ``ids[at]`` are in this bucket, exactly."""
        lo, hi = np.searchsorted(self.hashes, hashes[at]), np.searchsorted(self.hashes, hashes[at], side="right")
        out = np.zeros(len(at), dtype=bool)
        for k in range(int((hi - lo).max(initial=0))):
            some = np.flatnonzero(lo + k < hi)
            mine, theirs = pa.array(at[some]), pa.array(self.order[lo[some] + k])
            same = np.ones(len(some), dtype=bool)
            for a, b in zip(ids.columns, self.ids.columns):
                same &= np.asarray(pc.equal(a.take(mine), b.take(theirs)).fill_null(False).to_numpy(zero_copy_only=False))
            out[some] |= same
        return out


@dataclass
class Buckets:
    """Storage by time bucket, under a tree of summary filters; ``roots[n]`` has what no summary of level n + 1 covers yet."""

    roots: list[list] = field(default_factory=lambda: [[]])

    def add(self, stored: Stored) -> None:
        self.roots[0].append((stored.bloom, stored, [stored.hashes]))
        level = 0
        while len(self.roots[level]) == GROUP:
            group, self.roots[level] = self.roots[level], []
            held = [h for _, _, hashes in group for h in hashes]
            summary = BloomFilter(sum(map(len, held)))
            for h in held:
                summary.add(h)
            if level + 1 == len(self.roots):
                self.roots.append([])
            self.roots[level + 1].append((summary, group, held))
            level += 1

    def matching(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, Stored]]:
        """Buckets whose filters have some of the hashes, and which; all others are definitely new to a bucket."""
        open_ = [(node, np.arange(len(hashes))) for level in self.roots for node in level]
        while open_:
            (bloom, below, _), at = open_.pop()
            at = at[bloom.might_contain(hashes[at])]
            if not len(at):
                continue
            if isinstance(below, Stored):
                yield at, below
            else:
                open_ += [(node, at) for node in below]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each time bucket (the first column), from rows that are sorted by it."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets = np.asarray(batch.column(0))
        cuts = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(buckets)]):
            if buckets[lo] != at and held:
                yield pa.concat_batches(held)
                held = []
            at = buckets[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.concat_batches(held)


def _screened(batches: Iterator[pa.RecordBatch], n_ids: int) -> Iterator[pa.RecordBatch]:
    """The rows of a shard, by bucket, hash and identifier, with ``_again``: whether an earlier bucket has the identifier."""
    storage = Buckets()
    for batch in _runs(batches):
        hashes = np.asarray(batch.column(1))
        ids = batch.select(list(range(2, 2 + n_ids)))
        again = np.zeros(len(hashes), dtype=bool)
        for at, stored in storage.matching(hashes):
            at = at[~again[at]]
            again[at] = stored.has(ids, hashes, at)
        storage.add(Stored.of(ids, hashes))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(again)], names=[*batch.schema.names, "_again"])


def copies(df: DataFrame, ids: dict[str, Column], at_ms: Column, order: list[Column], bucket_ms: int, keep: list[str] = ()) -> DataFrame:
    """One row per identifier and time bucket: the identifier, _bucket, _hash, n, and ``_first``, the earliest copy.

    ``_first``, if any order or kept columns are given, is a struct of the order columns and the columns in ``keep``.
    Rows of which a part of the identifier is null are left out; a null time counts as bucket 0.
    """
    row = [c.alias(f"_o{i}") for i, c in enumerate(order)] + [df[c].alias(c) for c in keep]
    rows = df.select(
        *[c.alias(k) for k, c in ids.items()],
        F.coalesce(floor_div(at_ms, bucket_ms), F.lit(0).cast("bigint")).alias("_bucket"),
        *([F.struct(*row).alias("_row")] if row else []),
    )
    for k in ids:
        rows = rows.filter(F.col(k).isNotNull())
    each = rows.groupBy(*ids, "_bucket").agg(F.count("*").alias("n"), *([F.min("_row").alias("_first")] if row else []))
    return each.withColumn("_hash", F.xxhash64(*ids))


def shards_of(df: DataFrame) -> int:
    """How many shards the identifiers of a frame make, by Spark's estimate of its bytes."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # Where nothing is known of the size, Spark takes the greatest.
    return partitions(df.sparkSession) if size >= 1 << 62 else max(partitions(df.sparkSession), -(-size // SHARD_BYTES))


def screened(each: DataFrame, ids: list[str], width: int | None = None) -> DataFrame:
    """``each``, as from ``copies``, with ``_again``: whether an earlier time bucket has the identifier too.

    Identifiers are stored in shards by hash, as many as their bytes need, and by time bucket within a shard. A shard is
    one task: it passes the buckets in order, with a Bloom filter for each and summaries of these, which tell what is
    definitely new. A possible repeat is looked up, exactly, in the stored buckets whose filters have it and in no
    others. The rows move once, to their shard; nothing is collected, broadcast or joined.
    """
    ship_package(each.sparkSession)
    rows = each.select("_bucket", "_hash", *ids, *[c for c in each.columns if c not in ("_bucket", "_hash", *ids)])
    shards = width or shards_of(each)
    schema = T.StructType([*rows.schema.fields, T.StructField("_again", T.BooleanType())])
    placed = rows.repartitionById(shards, F.pmod("_hash", F.lit(shards)).cast("int")).sortWithinPartitions("_bucket")
    return placed.mapInArrow(lambda batches: _screened(batches, len(ids)), schema)


def deduplicate(df: DataFrame, ids: dict[str, Column], at_ms: Column, order: list[Column], bucket_ms: int, keep: list[str]) -> DataFrame:
    """Exactly one row, the earliest by time bucket and then ``order``, of every identifier: ids and ``keep``.

    Rows without a whole identifier cannot be told apart and are left out; take them from the input where wanted.
    """
    if set(ids) & set(keep):
        raise ValueError("keep must not name a part of the identifier")
    each = copies(df, ids, at_ms, order, bucket_ms, keep)
    each = each.select(*ids, "_bucket", "_hash", *[F.col(f"_first.{c}").alias(f"_k{i}") for i, c in enumerate(keep)])
    first = screened(each, list(ids)).filter(~F.col("_again"))
    return first.select(*ids, *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def redelivered(df: DataFrame, ids: dict[str, Column], at_ms: Column, bucket_ms: int) -> DataFrame:
    """Identifiers that more than one row has."""
    each = copies(df, ids, at_ms, [], bucket_ms)
    return screened(each, list(ids)).filter(F.col("_again") | (F.col("n") > 1)).select(*ids).distinct()
