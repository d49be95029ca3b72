"""Three-way status of files and the plans that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def three_way_status(local: DataFrame, remote: DataFrame, manifest: DataFrame) -> DataFrame:
    """(rel_path, status, sizes, hashes) of every path that any side knows.

    Hashes are compared with null as a value of its own.  Rows with a null path take no part.
    """
    l = local.where("rel_path is not null").select("rel_path", F.col("hash").alias("local_hash"), F.col("size").alias("local_size"), F.lit(True).alias("on_l"))
    r = remote.where("rel_path is not null").select("rel_path", F.col("hash").alias("remote_hash"), F.col("size").alias("remote_size"), F.lit(True).alias("on_r"))
    m = manifest.where("rel_path is not null").select(
        "rel_path", "synced_hash", F.coalesce(F.nullif("synced_remote_hash", F.lit("")), "synced_hash").alias("synced_remote"), F.lit(True).alias("on_m")
    )
    all_ = l.join(r, "rel_path", "full_outer").join(m, "rel_path", "full_outer")
    on = {k: F.coalesce(k, F.lit(False)) for k in ("on_l", "on_r", "on_m")}
    changed_l = ~F.col("local_hash").eqNullSafe(F.col("synced_hash"))
    changed_r = on["on_r"] & ~F.col("remote_hash").eqNullSafe(F.col("synced_remote"))
    status = (
        F.when(~on["on_m"], F.when(on["on_l"] & on["on_r"], "conflict").when(on["on_l"], "new_local").otherwise("new_remote"))
        .when(~on["on_l"], "deleted_local").when(changed_l & changed_r, "conflict").when(changed_l, "local_ahead").when(changed_r, "remote_ahead").otherwise("in_sync")
    )
    return all_.select("rel_path", status.alias("status"), "local_hash", "remote_hash", "local_size", "remote_size")


def status_counts(states: DataFrame) -> DataFrame:
    """(status, files)."""
    return states.groupBy("status").agg(F.count("*").alias("files"))


_PUSH = {"local_ahead": "upload", "new_local": "upload", "conflict": "conflict", "deleted_local": "delete"}
_PULL = {"remote_ahead": "download", "new_remote": "download", "conflict": "conflict"}


def _plan(states: DataFrame, buckets: dict[str, str], size: str) -> DataFrame:
    bucket = F.element_at(F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv]), F.col("status"))
    return states.where(F.col("status").isin(*buckets)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"), F.sum(F.coalesce(size, F.lit(0))).alias("bytes"))


def push_plan(states: DataFrame) -> DataFrame:
    """(bucket, files, bytes) of what a push uploads, deletes or finds in conflict; unknown sizes are 0."""
    return _plan(states, _PUSH, "local_size")


def pull_plan(states: DataFrame) -> DataFrame:
    """(bucket, files, bytes) of what a pull downloads or finds in conflict; unknown sizes are 0."""
    return _plan(states, _PULL, "remote_size")


def delete_plan(requested: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """(rel_path, bucket): where each requested path still is."""
    on = requested.select("rel_path").distinct().join(remote.select("rel_path", F.lit(1).alias("r")), "rel_path", "left").join(local.select("rel_path", F.lit(1).alias("l")), "rel_path", "left")
    return on.select("rel_path", F.expr("case when r = 1 and l = 1 then 'both' when r = 1 then 'remote_only' when l = 1 then 'local_only' else 'absent' end").alias("bucket"))


def conflicts(found: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_path): the conflicts of a status and those that a guard has found since, each once."""
    return found.where("status = 'conflict'").select("rel_path").union(new.where("not safe").select("rel_path")).distinct()


def drive_fields(listing: DataFrame) -> DataFrame:
    """The columns that a listing asks for, and no more."""
    return listing.select("id", "name", "hash")
