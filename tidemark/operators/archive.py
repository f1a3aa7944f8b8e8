"""Consolidation of many tiny files into indexed archive containers, and reading them back.

An archive is a table of blocks: the bytes of many files one after the other, with an entry for each file that tells its
offset, length and CRC-32. Blocks of one directory make containers. The index is the table of all entries, without bytes.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clean_path, directory, epoch_us
from tidemark.operators.skew import salted_join
from tidemark.session import partitions, ship_package

#: Files of one directory whose places are worked out in one task; a directory of more is laid out in several lanes.
LANE_FILES = 50_000
ENTRY = "path string, part int, offset bigint, length bigint, records bigint, crc32 bigint"
BLOCKS = f"dir string, container bigint, block bigint, content binary, entries array<struct<{ENTRY.replace(' ', ': ').replace(',:', ',')}>>"


def latest_listing(listings: DataFrame) -> DataFrame:
    """One row per file, by its listing with the latest listed_at (then the greatest listing_id): path, dir, closed, approx_bytes.

    Listings without a path are left out; a null listed_at is the earliest.
    """
    rows = listings.filter(F.col("path").isNotNull()).select(
        clean_path(F.col("path")).alias("path"),
        F.struct("listed_at", "listing_id", F.col("closed_at").isNotNull().alias("closed"), "approx_bytes").alias("_l"),
    )
    last = rows.groupBy("path").agg(F.max("_l").alias("_l"))
    return last.select("path", directory(F.col("path")).alias("dir"), "_l.closed", "_l.approx_bytes")


def small_files(listings: DataFrame, below_bytes: int = 4096) -> DataFrame:
    """The files to consolidate: closed, below ``below_bytes``, and not the only such file of their directory: path, dir, size."""
    small = latest_listing(listings).filter(F.col("closed") & (F.col("approx_bytes") < below_bytes)).select("path", "dir", F.col("approx_bytes").alias("size"))
    shared = small.groupBy("dir").agg(F.count("*").alias("_n")).filter("_n > 1").select("dir")
    return salted_join(small, shared, ["dir"], F.col("path")).select("path", "dir", "size")


def places(files: DataFrame, target_bytes: int) -> DataFrame:
    """The container of each file of ``files`` (path, dir, size), by sizes alone: path, dir, container.

    Within a directory, files follow each other by path, and a new container begins wherever ``target_bytes`` are full;
    so a container ends with the file that fills it. Directories of over ``LANE_FILES`` files are laid out in lanes by
    hash of the path, each with containers of its own, so no task orders the names of a whole directory.
    """
    known = files.select("path", "dir", F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0)).alias("_size"))
    lanes = known.groupBy("dir").agg(F.ceil(F.count("*") / LANE_FILES).alias("_lanes"))
    laned = salted_join(known, lanes, ["dir"], F.col("path")).withColumn("_lane", F.pmod(F.xxhash64(F.lit(2), "path"), F.col("_lanes")))
    before = Window.partitionBy("dir", "_lane").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("_size").over(before), F.lit(0))
    number = F.call_function("div", at, F.lit(target_bytes).cast("bigint"))
    return laned.select("path", "dir", (F.col("_lane") * (1 << 40) + number).alias("container"))


def _packed(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.RecordBatch]:
    """Blocks from rows that are sorted by directory, container and file; a block ends at ``target`` bytes.

    A row without data makes an entry and adds nothing to it. Of a file that goes on in the next block, each block has a part.
    """
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([(n, pa.string() if n == "path" else pa.int32() if n == "part" else pa.int64()) for n in _ENTRY_NAMES]))]
    at: tuple[str, int] | None = None
    block: list[bytes] = []
    entries: list[dict] = []
    size = number = 0

    def close() -> pa.RecordBatch:
        nonlocal block, entries, size, number
        content = b"".join(block)
        for e in entries:
            e["crc32"] = zlib.crc32(memoryview(content)[e["offset"] : e["offset"] + e["length"]])
        row = ([at[0]], [at[1]], [number], [content], [entries])
        block, entries, size, number = [], [], 0, number + 1
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["dir", "container", "block", "content", "entries"])

    last, part = None, 0
    for batch in batches:
        for where, container, path, data in zip(*(c.to_pylist() for c in batch.columns)):
            if (where, container) != at or size and (size >= target or size + len(data or b"") > target):
                if entries:
                    yield close()
                if (where, container) != at:
                    at, number, last = (where, container), 0, None
            if path != last:
                last, part = path, 0
            if not entries or entries[-1]["path"] != path:
                entries.append({"path": path, "part": part, "offset": size, "length": 0, "records": 0})
                part += 1
            if data is not None:
                entries[-1]["length"] += len(data)
                entries[-1]["records"] += 1
                block.append(data)
                size += len(data)
    if entries:
        yield close()


_ENTRY_NAMES = [field.split(" ")[0] for field in ENTRY.split(", ")]


def _pack(placed: DataFrame, rows: DataFrame, target_bytes: int, many: bool) -> DataFrame:
    """Blocks of the files in ``placed`` (path, dir, container) from ``rows`` (path, _id, data), which move to their containers.

    ``many`` says that a path may have any number of rows.
    """
    ship_package(rows.sparkSession)
    joined = salted_join(rows, placed, ["path"], F.coalesce(F.col("_id"), F.lit(0))) if many else rows.join(placed, "path")
    # Each file comes once without data as well, before its rows, so that empty files have an entry.
    found = joined.select("dir", "container", "path", "_id", "data", F.lit(1).alias("_row"))
    marks = placed.select("dir", "container", "path", F.lit(None).cast("bigint").alias("_id"), F.lit(None).cast("binary").alias("data"), F.lit(0).alias("_row"))
    return (
        found.unionByName(marks)
        .repartition(partitions(rows.sparkSession), "dir", "container")
        .sortWithinPartitions("dir", "container", "path", "_row", "_id", "data")
        .select("dir", "container", "path", "data")
        .mapInArrow(lambda batches: _packed(batches, target_bytes), BLOCKS)
    )


def _checked_target(target_bytes: int) -> int:
    if target_bytes <= 0:
        raise ValueError("target_bytes must be positive")
    return target_bytes


def pack(files: DataFrame, records: DataFrame, target_bytes: int = 64 << 20) -> DataFrame:
    """Archive blocks of the files in ``files`` (path, dir, size), whose records are a table: dir, container, block, content, entries.

    ``records`` has record_id, path in any spelling, event_time and payload. A record's bytes are its values as a line
    of JSON, nulls included; a file's bytes are its lines by record_id. A file without records has an entry of no bytes.
    Records that come twice stay twice. Containers follow from the listed sizes (``places``), so only names are ordered
    for that, and a large directory is packed by many tasks. A container's blocks end at ``target_bytes``, whatever was
    listed; a file that does not fit has an entry in each block it reaches into, with its ``part``.
    """
    line = F.to_json(
        F.struct(F.col("record_id").alias("id"), epoch_us(records, "event_time").alias("us"), F.col("payload").alias("p")),
        {"ignoreNullFields": "false"},
    )
    rows = records.filter(F.col("path").isNotNull()).select(
        clean_path(F.col("path")).alias("path"), F.col("record_id").alias("_id"), F.encode(F.concat(line, F.lit("\n")), "UTF-8").alias("data")
    )
    return _pack(places(files, _checked_target(target_bytes)), rows, target_bytes, True)


def pack_files(spark: SparkSession, paths: str | list[str], target_bytes: int = 64 << 20, below_bytes: int | None = None) -> DataFrame:
    """Archive blocks of real files, byte for byte: those of folders, files or patterns, and of folders within, under ``below_bytes``.

    Sizes come from the listing, so containers are planned before a file is opened. A path is the file's URI.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    if below_bytes is not None:
        found = found.filter(F.col("length") < below_bytes)
    # Spark's scans pass over files of no bytes; their names are in the listing that the driver's JVM holds anyway.
    jvm = spark._jvm
    names = jvm.scala.collection.JavaConverters.seqAsJavaList(jvm.scala.collection.mutable.ArraySeq.make(found._jdf.inputFiles()))
    listed = DataFrame(spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    plain = F.regexp_replace(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):///", "$1:/")
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")
    files = listed.select(plain.alias("path")).join(sizes, "path", "left").select("path", directory(F.col("path")).alias("dir"), F.coalesce("length", F.lit(0)).alias("size"))
    if below_bytes is not None:
        files = files.filter(F.col("size") < below_bytes)
    rows = found.select("path", F.lit(0).cast("bigint").alias("_id"), F.col("content").alias("data"))
    return _pack(places(files, _checked_target(target_bytes)), rows, target_bytes, False)


def index(blocks: DataFrame) -> DataFrame:
    """The entries of blocks: path, dir, container, block, part, offset, length, records, crc32. The content is not read."""
    each = blocks.select("dir", "container", "block", F.explode("entries").alias("e"))
    return each.select("e.path", "dir", "container", "block", *[f"e.{n}" for n in _ENTRY_NAMES[1:]])


def contents(blocks: DataFrame) -> DataFrame:
    """The bytes of every file in blocks, part by part: path, part, data. A wrong checksum is an error."""
    each = blocks.select("content", F.explode("entries").alias("e"))
    data = F.expr("substring(content, CAST(e.offset AS INT) + 1, CAST(e.length AS INT))")
    whole = F.when(F.crc32(data) == F.col("e.crc32"), data).otherwise(F.raise_error(F.concat(F.lit("checksum differs: "), F.col("e.path"))).cast("binary"))
    return each.select("e.path", "e.part", whole.alias("data"))


def unpack(blocks: DataFrame, path: str | None = None) -> DataFrame:
    """The records of archive blocks, or of one file: record_id, path, event_us, payload. A wrong checksum is an error."""
    if path is not None:
        blocks = blocks.withColumn("entries", F.filter("entries", lambda e: e["path"] == path)).filter(F.size("entries") > 0)
    lines = contents(blocks).select("path", F.explode(F.split(F.decode("data", "UTF-8"), "\n")).alias("_line")).filter("_line <> ''")
    parsed = lines.withColumn("_r", F.from_json("_line", "id bigint, us bigint, p string"))
    return parsed.select(F.col("_r.id").alias("record_id"), "path", F.col("_r.us").alias("event_us"), F.col("_r.p").alias("payload"))


def write_archives(blocks: DataFrame, out: str) -> None:
    """Writes blocks and their index as Parquet, under ``out``/blocks, by directory, and ``out``/index, by path.

    The writer looks at its size after every block, so a row group holds few of these large rows, and reading takes no
    more memory than writing. The index is made from the entries that were written; the blocks are not packed again.
    """
    rows = blocks.withColumn("directory", F.col("dir"))
    sizes = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    rows.write.partitionBy("directory").options(**sizes).parquet(os.path.join(out, "blocks"))
    found = index(blocks.sparkSession.read.parquet(os.path.join(out, "blocks")))
    # By ranges of the path, so that a lookup reads the footers' bounds and one piece.
    found.repartitionByRange("path").sortWithinPartitions("path", "part").write.parquet(os.path.join(out, "index"))


def lookup(spark: SparkSession, out: str, path: str) -> bytes | None:
    """The bytes of one file of a written archive, None if it has none of that path.

    The index gives the blocks; of these, only the rows of the directory, container and number are read.
    """
    found = spark.read.parquet(os.path.join(out, "index")).filter(F.col("path") == path).orderBy("part").collect()
    if not found:
        return None
    blocks = spark.read.parquet(os.path.join(out, "blocks"))
    data = []
    for e in found:
        some = blocks.filter((F.col("directory") == e["dir"]) & (F.col("dir") == e["dir"]) & (F.col("container") == e["container"]) & (F.col("block") == e["block"]))
        piece = bytes(some.select(F.expr(f"substring(content, {e['offset'] + 1}, {e['length']})").alias("d")).first()["d"])
        if zlib.crc32(piece) != e["crc32"]:
            raise ValueError(f"checksum of {path} differs")
        data.append(piece)
    return b"".join(data)
