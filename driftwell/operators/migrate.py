"""Snapshots from folders of copies to content-addressed blobs and back.

Blobs are a versioned table (``sources.commits``) with the hash as key: each body is stored once, a second migration
finds everything there and publishes nothing.  Which hashes may be stored is told by a Bloom filter first, so bodies that
are surely new are never shuffled for the exact comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.sources.commits import Version, VersionedTable

BLOB = "h string, content binary"
LIST = "entry string, timestamp string, path string, hash string"
COPY = "entry string, timestamp string, path string, content binary"
#: Bytes of a part of the Bloom filter; the whole filter is broadcast while it has at most ``FILTER_BYTES``.
_PART, FILTER_BYTES, _PROBES = 4096, 32 << 20, 4


def entry(timestamp: Column, path: Column) -> Column:
    """A snapshot's file as one key; the length keeps times and paths apart."""
    return F.concat(F.length(timestamp).cast("string"), F.lit(":"), timestamp, path)


def blob_store(spark: SparkSession, root: str, shards: int = 64) -> VersionedTable:
    return VersionedTable(spark, f"{root}/blobs", BLOB, "h", shards)


def blob_lists(spark: SparkSession, root: str, shards: int = 64) -> VersionedTable:
    return VersionedTable(spark, f"{root}/lists", LIST, "entry", shards)


def full_copies(spark: SparkSession, root: str, shards: int = 64) -> VersionedTable:
    return VersionedTable(spark, f"{root}/full", COPY, "entry", shards)


def _places(h: Column, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(h, F.lit(i)), F.lit(bits)) for i in range(_PROBES)])


def bloom(hashes: DataFrame, bits: int) -> DataFrame:
    """(part, map): a Bloom filter of (h) as bitmaps of ``_PART`` bytes, put together on the executors; parts without a bit are left out."""
    size = _PART * 8
    bit = hashes.where("h is not null").select(F.explode(_places(F.col("h"), bits)).alias("bit"))
    return bit.groupBy(F.expr(f"bit div {size}").alias("part")).agg(F.bitmap_construct_agg(F.expr(f"bit % {size}")).alias("map"))


def split_by_bloom(candidates: DataFrame, stored: DataFrame, count: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(surely new, perhaps stored) of distinct candidates (h).  Nothing stored is ever among the new.

    The filter has ten bits for each of ``count`` hashes (counted where it is not given).  Its size is known before it is
    made: beyond ``FILTER_BYTES`` there is none, and all candidates go to the exact comparison.
    """
    count = stored.count() if count is None else count
    bits = max(_PART * 8, -(-count * 10 // (_PART * 8)) * _PART * 8)
    if bits // 8 > FILTER_BYTES or not count:
        return (candidates, candidates.limit(0)) if not count else (candidates.limit(0), candidates)
    parts = F.broadcast(bloom(stored, bits).select("part", "map"))
    probe = candidates.select("h", F.explode(_places(F.col("h"), bits)).alias("bit")).select("h", F.expr(f"bit div {_PART * 8}").alias("part"), F.expr(f"int(bit % {_PART * 8})").alias("at"))
    byte = F.conv(F.hex(F.expr("substring(map, at div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.expr("at % 8")) == 1, F.lit(False))
    seen = probe.join(parts, "part", "left").groupBy("h").agg(F.min(hit.cast("int")).alias("all"))
    return seen.where("all = 0").select("h"), seen.where("all = 1").select("h")


def to_blobs(copies: DataFrame, blobs: VersionedTable, lists: VersionedTable, transaction: tuple[str, int] | None = None) -> tuple[Version, Version]:
    """Stores the bodies of full snapshots (timestamp, path, content) that are not stored yet, then their lists.

    Lists are published after the bodies they name, so no reader meets a list whose bodies are missing; a crash in between
    leaves bodies that a second run finds.  Rows with a null time, path or content take no part.
    """
    rows = copies.where("timestamp is not null and path is not null and content is not null").withColumn("h", F.sha2("content", 256))
    first = blobs.version()
    new, perhaps = split_by_bloom(rows.select("h").distinct(), blobs.read(first).select("h"))
    missing = new.union(perhaps.join(blobs.read(first).select("h"), "h", "left_anti"))
    bodies = rows.join(missing, "h", "left_semi").groupBy("h").agg(F.any_value("content").alias("content"))
    if first.number and missing.isEmpty():  # hashes tell, so no body is shuffled to find out
        bodies = rows.limit(0)
    done = blobs.add(bodies.select("h", "content"), transaction, unique=True)
    listed = rows.select(entry(F.col("timestamp"), F.col("path")).alias("entry"), "timestamp", "path", F.col("h").alias("hash"))
    return done, lists.add(listed, transaction)


def to_full(lists: DataFrame, blobs: DataFrame, full: VersionedTable, transaction: tuple[str, int] | None = None) -> Version:
    """Writes copies of the files that lists (timestamp, path, hash) name; snapshots that are there already are left alone.

    A body that is missing, or whose SHA-256 is another, is an error, and nothing is published.
    """
    wanted = lists.where("timestamp is not null and path is not null").select(entry(F.col("timestamp"), F.col("path")).alias("entry"), "timestamp", "path", "hash")
    first = full.version()
    wanted = wanted.dropDuplicates(["entry"])
    wanted = wanted.join(full.read(first).select("entry"), "entry", "left_anti") if first.number else wanted
    if first.number and wanted.isEmpty():
        wanted, blobs = wanted.limit(0), blobs.limit(0)
    bodies = wanted.join(blobs.select(F.col("h").alias("hash"), "content"), "hash", "left")
    intact = F.sha2("content", 256) == F.col("hash")
    checked = F.when(intact, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("no intact body for "), "path")))
    return full.add(bodies.select("entry", "timestamp", "path", checked.alias("content")), transaction, unique=True)


def forget(timestamps: list[str], lists: VersionedTable) -> Version:
    """Takes the lists of some snapshots out; bodies stay until nothing refers to them (``snapshots.orphans``)."""
    rows = lists.read()
    return lists.merge(rows.limit(0), rows.where(F.col("timestamp").isin(timestamps)).select("entry"))
