"""Manifests, hash caches and the queues that follow from them.  Rows with a null path take no part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, held: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows of ``stored`` and ``held`` by path: what is held wins, paths in ``removed`` go from both.  Each has a path once."""
    columns = [c for c in stored.columns if c != "rel_path"]
    h = held.where("rel_path is not null").select("rel_path", F.struct(*columns).alias("h"))
    s = stored.where("rel_path is not null").select("rel_path", F.struct(*columns).alias("s"))
    return s.join(h, "rel_path", "full_outer").select("rel_path", F.coalesce("h", "s").alias("x")).select("rel_path", "x.*").join(removed.select("rel_path"), "rel_path", "left_anti")


def active_only(manifest: DataFrame, active: list[str]) -> DataFrame:
    """The manifest with only active backends in ``remotes``, and ``n_removed``, how many each row had besides."""
    kept = F.map_filter("remotes", lambda k, _: k.isin(list(active)))
    return manifest.withColumn("n_removed", (F.size("remotes") - F.size(kept)).cast("bigint")).withColumn("remotes", kept)


def waits(manifest: DataFrame) -> DataFrame:
    """(rel_path, waits): whether any backend of a path waits for another try."""
    return manifest.where("rel_path is not null").select("rel_path", F.exists(F.map_values("remotes"), lambda r: r["state"] == "pending_retry").alias("waits"))


def probe(local: DataFrame, cache: DataFrame, kind: str = "md5") -> DataFrame:
    """(rel_path, size, mtime_ns, hash): the cached hash of files whose size and time have not changed, else null.

    An empty hash is none.  Cache rows are one a path.
    """
    hit = cache.select("rel_path", "size", "mtime_ns", F.nullif(kind, F.lit("")).alias("hash"))
    return local.where("rel_path is not null").select("rel_path", "size", "mtime_ns").join(hit, ["rel_path", "size", "mtime_ns"], "left")


def put_hashes(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows (rel_path, size, mtime_ns, md5, sha256); a null hash in one keeps the cached one if size and time are the same."""
    old = cache.select("rel_path", F.struct("size", "mtime_ns", "md5", "sha256").alias("o"))
    both = old.join(new.where("rel_path is not null").select("rel_path", F.struct("size", "mtime_ns", "md5", "sha256").alias("n")), "rel_path", "full_outer")
    same = F.expr("o.size = n.size and o.mtime_ns = n.mtime_ns")
    pick = lambda c: F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", F.when(same, F.col(f"o.{c}")), F.lit("")))
    return both.select("rel_path", F.coalesce("n.size", "o.size").alias("size"), F.coalesce("n.mtime_ns", "o.mtime_ns").alias("mtime_ns"), pick("md5").alias("md5"), pick("sha256").alias("sha256"))


def prune_cache(cache: DataFrame, local: DataFrame) -> DataFrame:
    """The cache rows of files that are still there."""
    return cache.join(local.select("rel_path"), "rel_path", "left_semi")


def prompt_state(local: DataFrame, manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """One row (local_ahead, remote_ahead, conflicts, in_sync) without a look at any remote.

    A file is ahead if it was never synced, if the cache does not know it as it is, or if its hash differs; nothing is known
    of the remote side, so none is ahead there; paths that wait for a mirror count as conflicts.
    """
    seen = probe(local, cache).join(manifest.where("rel_path is not null").select("rel_path", "synced_hash"), "rel_path", "left")
    fresh = (F.coalesce("synced_hash", F.lit("")) == "") | F.col("hash").isNull() | (F.col("hash") != F.col("synced_hash"))
    ahead = seen.agg(F.count_if(fresh).alias("local_ahead"))
    stuck = waits(manifest).agg(F.count_if("waits").alias("conflicts"))
    return ahead.join(stuck, how="cross").select("local_ahead", F.lit(0).cast("bigint").alias("remote_ahead"), "conflicts", (F.col("local_ahead") + F.col("conflicts") == 0).alias("in_sync"))


def guarded(push: DataFrame, manifest: DataFrame) -> DataFrame:
    """(rel_path, safe): whether the remote is as it was last synced; without a hash now, or a manifest row, a push is safe.

    ``push`` holds (rel_path, remote_hash).
    """
    base = F.coalesce(F.nullif("synced_remote_hash", F.lit("")), "synced_hash")
    seen = push.where("rel_path is not null").join(manifest.select("rel_path", base.alias("base"), F.lit(True).alias("known")), "rel_path", "left")
    moved = F.col("known").isNotNull() & (F.coalesce("remote_hash", F.lit("")) != "") & ~F.col("remote_hash").eqNullSafe(F.col("base"))
    return seen.select("rel_path", (~moved).alias("safe"))


def retry_queue(remotes: DataFrame, most: int = 200) -> DataFrame:
    """(rel_path): paths that wait on any mirror, each once, the first ``most`` by path."""
    return remotes.where("state = 'pending_retry' and rel_path is not null").select("rel_path").distinct().orderBy("rel_path").limit(most)


def expand_queue(queued: DataFrame, waiting: DataFrame, states: DataFrame) -> DataFrame:
    """(rel_path): what is queued, and what waits, is not queued yet and has a state."""
    more = waiting.select("rel_path").join(queued.select("rel_path"), "rel_path", "left_anti").join(states.select("rel_path"), "rel_path", "left_semi")
    return queued.select("rel_path").union(more)


def seed_plan(manifest: DataFrame, remotes: DataFrame, local: DataFrame, backend: str) -> DataFrame:
    """(rel_path, action) of files that a mirror does not have: seed, skipped_drift where the file has changed since the last sync, failed where it is gone."""
    have = remotes.where(F.col("backend") == backend).select("rel_path")
    want = manifest.where("rel_path is not null").select("rel_path", "synced_hash").join(have, "rel_path", "left_anti")
    seen = want.join(local.select("rel_path", "hash", F.lit(True).alias("there")), "rel_path", "left")
    action = F.when(F.col("there").isNull(), "failed").when((F.coalesce("synced_hash", F.lit("")) != "") & ~F.col("hash").eqNullSafe(F.col("synced_hash")), "skipped_drift").otherwise("seed")
    return seen.select("rel_path", action.alias("action"))


def seed_counts(plan: DataFrame) -> DataFrame:
    """One row (total, seeded, skipped_drift, failed)."""
    n = {a: F.count_if(F.col("action") == a) for a in ("seed", "skipped_drift", "failed")}
    return plan.agg(F.count("*").alias("total"), n["seed"].alias("seeded"), n["skipped_drift"].alias("skipped_drift"), n["failed"].alias("failed"))


def quarantine_alerts(remotes: DataFrame) -> DataFrame:
    """(backend, files, last_error): an alert for each backend with paths given up; the last error that says anything, by ``ord``."""
    error = F.max(F.when(F.coalesce("last_error", F.lit("")) != "", F.struct("ord", "last_error")))["last_error"]
    return remotes.where("state = 'failed_perm'").groupBy("backend").agg(F.countDistinct("rel_path").alias("files"), F.coalesce(error, F.lit("")).alias("last_error"))


#: Fixed value: how many tries on one content before a path is given up.
MOST_TRIES = 10


def attempts(log: DataFrame, most: int = MOST_TRIES) -> DataFrame:
    """(rel_path, backend, ord, state, attempts) after each outcome of a log (rel_path, backend, ord, state, intended_hash).

    Success sets the count to 0; a content not tried before starts at 1; any other failure adds one.  From ``most`` on a
    path that waits is given up.  An empty intended hash says nothing of the content.  ``ord`` has no ties in a path and backend.
    """
    order = Window.partitionBy("rel_path", "backend").orderBy("ord")
    hash_ = F.coalesce("intended_hash", F.lit(""))
    starts = (F.col("state") == "ok") | ((hash_ != "") & (hash_ != F.lag(hash_, 1, "").over(order)))
    run = F.sum(starts.cast("int")).over(order)
    within = Window.partitionBy("rel_path", "backend", "run").orderBy("ord")
    n = F.row_number().over(within) - (F.first("state").over(within) == "ok").cast("int")
    counted = log.where("rel_path is not null").withColumn("run", run).withColumn("attempts", n.cast("bigint"))
    state = F.when((F.col("state") == "pending_retry") & (F.col("attempts") >= most), "failed_perm").otherwise(F.col("state"))
    return counted.select("rel_path", "backend", "ord", state.alias("state"), "attempts")


def after_success(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest after pushes (rel_path, synced_hash, remote_file_id, synced_at, synced_remote_hash): flat fields are the new ones, mirrors stay."""
    flat = ["synced_hash", "remote_file_id", "synced_at", "synced_remote_hash"]
    new = done.where("rel_path is not null").select("rel_path", F.struct(*flat).alias("n"))
    both = manifest.select("rel_path", F.struct(*flat).alias("o"), "remotes").join(new, "rel_path", "full_outer")
    return both.select("rel_path", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in flat], "remotes")


def after_pull(pulled: DataFrame, mirrors: list[str]) -> DataFrame:
    """(rel_path, backend, state, intended_hash): every mirror of a pulled path (rel_path, hash) waits for the new content."""
    return pulled.where("rel_path is not null").select("rel_path", F.explode(F.array(*map(F.lit, mirrors))).alias("backend"), F.lit("pending_retry").alias("state"), F.col("hash").alias("intended_hash"))


def fan_out(outcomes: DataFrame) -> DataFrame:
    """(rel_path, backend, state) of uploads to mirrors (rel_path, backend, error_class, null where it went well)."""
    from driftwell.functions.text import mirror_state

    return outcomes.select("rel_path", "backend", mirror_state(F.col("error_class")).alias("state"))


def overlay(project: DataFrame, profile: DataFrame) -> DataFrame:
    """(key, value) of settings as JSON texts: the project's where it says anything (not null, empty, false or 0), else the profile's."""
    empty = ["", '""', "0", "0.0", "false", "[]", "{}", "null"]
    p = project.select("key", F.when(~F.coalesce("value", F.lit("")).isin(empty), F.col("value")).alias("own"), F.col("value").alias("said"))
    both = p.join(profile.select("key", F.col("value").alias("other")), "key", "full_outer")
    return both.select("key", F.coalesce("own", "other", "said").alias("value"))
