"""States of files on several backends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def backend_status(remotes: DataFrame) -> DataFrame:
    """(backend, status, counts, last_error): the worst state wins; the last error is that of the largest ``ord``."""
    n = {s: F.count_if(F.col("state") == s) for s in ("ok", "pending_retry", "failed_perm")}
    status = F.when(n["failed_perm"] > 0, "failed").when(n["pending_retry"] > 0, "pending").otherwise("ok")
    error = F.max(F.when(F.coalesce("last_error", F.lit("")) != "", F.struct("ord", "last_error")))["last_error"]
    return remotes.groupBy("backend").agg(status.alias("status"), n["ok"].alias("ok"), n["pending_retry"].alias("pending"), n["failed_perm"].alias("failed"), error.alias("last_error"))


def by_backend(manifest: DataFrame, remotes: DataFrame, backends: list[str]) -> DataFrame:
    """A row for each path, a column for each backend: ok, pending, failed or unseeded; of rows that repeat a cell the least state."""
    cell = F.expr("case state when 'pending_retry' then 'pending' when 'failed_perm' then 'failed' else state end")
    wide = remotes.groupBy("rel_path").pivot("backend", backends).agg(F.min(cell))
    out = manifest.where("rel_path is not null").select("rel_path").join(wide, "rel_path", "left")
    return out.select("rel_path", *[F.coalesce(b, F.lit("unseeded")).alias(b) for b in backends])


def unseeded(manifest: DataFrame, remotes: DataFrame, backend: str) -> DataFrame:
    """(rel_path): paths of the manifest without a state on the backend; null paths take no part."""
    return manifest.where("rel_path is not null").select("rel_path").join(remotes.where(F.col("backend") == backend), "rel_path", "left_anti")


def retry_plan(remotes: DataFrame) -> DataFrame:
    """(rel_path, backends): backends where a path waits for another try."""
    return remotes.where("state = 'pending_retry' and rel_path is not null").groupBy("rel_path").agg(F.array_join(F.sort_array(F.collect_list("backend")), ",").alias("backends"))


def audit(manifest: DataFrame, remotes: DataFrame, backends: list[str]) -> DataFrame:
    """(backend, checked, drift, verified): unseeded and waiting files count as checked and verified."""
    # backends are configuration; each manifest row gets one row for each of them
    targets = manifest.where("rel_path is not null").select("rel_path", "synced_hash", F.explode(F.array(*map(F.lit, backends))).alias("backend"))
    seen = targets.join(remotes.select("rel_path", "backend", "state", "remote_hash"), ["rel_path", "backend"], "left")
    drift = F.coalesce((F.col("state") == "ok") & ~F.col("remote_hash").eqNullSafe(F.col("synced_hash")), F.lit(False))
    return seen.groupBy("backend").agg(F.count("*").alias("checked"), F.count_if(drift).alias("drift"), F.count_if(~drift).alias("verified"))


def quarantine(remotes: DataFrame) -> DataFrame:
    """(backend, files, first_path): paths given up on each backend; a null path counts, but is not the first."""
    return remotes.where("state = 'failed_perm'").groupBy("backend").agg(F.count("*").alias("files"), F.min("rel_path").alias("first_path"))


def live_matrix(states: DataFrame, listings: DataFrame, remotes: DataFrame, backends: list[str]) -> DataFrame:
    """A row for each path, a column for each backend, from what each lists now.

    ``states`` holds (rel_path, local_hash, synced_hash, known), ``listings`` (rel_path, backend).  A waiting or given-up
    state goes first; a file that was never synced is ``new local``, one without a state on a backend ``unseeded``, one that
    has a state but is not listed ``absent``, one that is gone here ``deleted``, one changed here ``local ahead``.
    """
    cells = states.where("rel_path is not null").select("*", F.explode(F.array(*map(F.lit, backends))).alias("backend"))
    seen = cells.join(remotes.select("rel_path", "backend", "state"), ["rel_path", "backend"], "left").join(listings.select("rel_path", "backend", F.lit(True).alias("listed")).distinct(), ["rel_path", "backend"], "left")
    cell = (
        F.when(F.col("state") == "pending_retry", "pending").when(F.col("state") == "failed_perm", "failed").when(~F.col("known"), "new local")
        .when(F.col("state").isNull(), "unseeded").when(F.col("listed").isNull(), "absent").when(F.col("local_hash").isNull(), "deleted")
        .when(F.col("local_hash") != F.col("synced_hash"), "local ahead").otherwise("ok")
    )
    return seen.groupBy("rel_path").pivot("backend", backends).agg(F.min(cell))
