"""Queries of manifests, snapshots, checks, listings and the log beyond the first catalogue, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import checks, log, manifest, mirrors, snapshots, status, tree
from driftwell.plans.catalog import _FILES, _LOG, _SIZES, _SNAPS, _states
from driftwell.sources import json_files
from driftwell.sources import tables as t

_NOW = "2024-01-20 06:00:00"


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


def _blob_table(s, d):
    return t.blobs(s, d)[1].select("h", F.concat(F.lit("b"), "h").alias("id"))


def _disk(s, d):
    return t.manifest(s, d)


def _held(s, d):
    return t.manifest(s, d).where("rel_path like '%/en/%'").select("rel_path", F.reverse("synced_hash").alias("synced_hash"), "synced_remote_hash").unionByName(
        t.local_files(s, d).where("rel_path like '%1.md'").select(F.concat(F.lit("new/"), "rel_path").alias("rel_path"), F.col("hash").alias("synced_hash"), F.lit("").alias("synced_remote_hash"))
    )


def _removed(s, d):
    return t.manifest(s, d).where("rel_path like '%/de/%'").select("rel_path")


def _pushed(s, d):
    return _states(s, d).where("status in ('local_ahead', 'new_local')").select("rel_path", "remote_hash")


def _remotes_with_live(s, d):
    r = t.manifest_remotes(s, d)
    live = r.where("ord % 19 <> 0").select("rel_path", "backend", F.when(F.col("ord") % 17 == 0, "other").otherwise(F.col("remote_hash")).alias("hash"))
    return r, live


def _full(s, d):
    return t.snapshots(s, d).where("timestamp < '1995-06'").select("timestamp")


def _blobs_snaps(s, d):
    return t.snapshots(s, d).where("timestamp >= '1995-03'").select("timestamp")


def _verify(s, d):
    r, live = _remotes_with_live(s, d)
    b = t.stored_blobs(s, d)
    return checks.verify({
        "manifest": checks.manifest_findings(t.manifest(s, d), r, live, t.BACKENDS), "snapshots": checks.blob_findings(b),
        "cache": checks.cache_findings(b.where("backend = 'drive'").select("name", "content")),
    })


def _health(s, d):
    now = F.lit("2024-02-03 00:00:00")
    rows = [checks.last_sync_age(t.sync_events(s, d), now), checks.last_sync_age(t.sync_events(s, d).limit(0), now)]
    return reduce(DataFrame.union, rows)


def _matrix(s, d):
    local, m = t.local_files(s, d), t.manifest(s, d)
    states = m.select("rel_path", "synced_hash", F.lit(True).alias("known")).join(local.select("rel_path", F.col("hash").alias("local_hash")), "rel_path", "full_outer").select("rel_path", "local_hash", "synced_hash", F.coalesce("known", F.lit(False)).alias("known"))
    listings = t.manifest_remotes(s, d).where("ord % 19 <> 0").select("rel_path", "backend")
    return mirrors.live_matrix(states, listings, t.manifest_remotes(s, d), t.BACKENDS)


def _settings(s, d, shift: int):
    """(key, value): a setting for each customer, in five kinds; some are missing."""
    i = F.col("c_custkey")
    value = F.when((i + shift) % 5 == 0, "false").when((i + shift) % 5 == 1, '""').when((i + shift) % 5 == 2, F.concat(F.lit(f"v{shift}-"), i.cast("string"))).when((i + shift) % 5 == 3, "0").otherwise("[1]")
    return s.read.parquet(f"{d}/customer.parquet").where(i % 7 != shift).select(F.concat(F.lit("k"), i.cast("string")).alias("key"), value.alias("value"))


def _cache(s, d):
    return _docs(s, d).select(F.md5("text").alias("h"), F.col("n_chars").alias("size"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("doc_id") * 37 % 5000).cast("int"))).alias("atime"), F.col("doc_id").cast("string").alias("name")).select("name", "size", "atime")


QUERIES = {
    "s17_manifest_files": lambda s, d: json_files.manifest(t.manifest_texts(s, d)).select("rel_path", "synced_hash", "remote_file_id", "synced_at", "synced_remote_hash", F.size("remotes").cast("bigint").alias("n_remotes"), F.element_at("remotes", "sftp")["state"].alias("sftp"), F.element_at("remotes", "sftp")["attempts"].alias("attempts")),
    "s19_cache_files": lambda s, d: json_files.hash_cache(t.hash_cache(s, d).select(F.to_json(F.create_map("rel_path", F.array(F.col("size").cast("string"), F.col("mtime_ns").cast("string"), "md5", "sha256"))).alias("text"))),
    "s20_catalogue": lambda s, d: json_files.snapshot_catalogue(t.snapshot_notes(s, d).where("timestamp < '1995-06'"), t.snapshot_notes(s, d).where("timestamp >= '1995-03'")).select("timestamp", "format", "triggered_by", "action", "total_files", "tag", F.size("files_changed").cast("bigint").alias("changed")),
    "s21_source_of_snapshots": lambda s, d: snapshots.first_source(t.snapshots(s, d).select("timestamp", F.explode(F.array(*[F.struct(F.lit(b).alias("backend"), F.lit(k).alias("priority")) for k, b in enumerate(t.BACKENDS)])).alias("b"), F.day(F.col("timestamp").cast("date")).alias("n")).where("n % 3 <= b.priority").select("timestamp", "b.backend", "b.priority", F.when(F.col("n") % 2 == 0, "blobs").otherwise("full").alias("format"))),
    "s22_snapshot_files": lambda s, d: json_files.snapshot_files(t.snapshot_files(s, d).groupBy("timestamp").agg(F.to_json(F.struct(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "hash")))).alias("files"))).alias("text"))),
    "s23_full_files": lambda s, d: json_files.full_files(t.snapshot_files(s, d).select("timestamp", F.when(F.col("path") == "p1/f1", "_snapshot_meta.json").otherwise(F.col("path")).alias("path"), F.md5("path").alias("id"), F.when(F.length("path") > 5, F.length("path")).alias("size"))).select("timestamp", "path", "id", F.col("size").cast("bigint").alias("size")),
    "s24_identifiers": lambda s, d: snapshots.at_time(t.snapshot_files(s, d), "1995-04"),
    "s25_blob_bodies": lambda s, d: snapshots.bodies(_docs(s, d).select(F.sha2("text", 256).alias("h")), t.stored_blobs(s, d).where("backend = 'drive'").groupBy(F.col("name").alias("h")).agg(F.max("content").alias("content"))).select("h", F.col("content").isNotNull().alias("stored")),
    "s26_log_files": lambda s, d: json_files.sync_log_parts(t.log_texts(s, d), "machine", "part").select("machine", "ord", "user", "timestamp", "action", F.array_join("files", "|").alias("files"), F.size("auto_resolved_files").cast("bigint").alias("resolved")),
    "s27_messages": lambda s, d: json_files.events(t.sync_events(s, d).select(F.when(F.col("ord") % 9 == 0, "no json").otherwise(F.to_json(F.struct("user", F.when(F.col("ord") % 4 > 0, F.col("machine")).alias("machine"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), "files", "action"))).alias("text"))).groupBy("user", "machine", "timestamp", "action").agg(F.count("*").alias("events")),
    "s29_envelopes": lambda s, d: json_files.envelopes(_docs(s, d).select(F.when(F.col("doc_id") % 6 == 0, "[]").otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("local_text"), F.when(F.col("doc_id") % 5 > 0, "r").alias("remote_text"), (F.col("doc_id") % 3).alias("version")))).alias("text"))).select("path", "local_text", "remote_text"),
    "s31_frozen_view": lambda s, d: snapshots.frozen_view(t.snapshot_files(s, d), t.snapshot_files(s, d).select("hash").distinct().where("hash < 'c'").select("hash", F.length("hash").cast("bigint").alias("size")), "1995-04"),
    "s32_mirror_view": lambda s, d: snapshots.mirror_view(t.manifest_remotes(s, d), "sftp", t.BACKENDS).select("rel_path", "state"),
    "s33_all_view": lambda s, d: snapshots.all_view(t.snapshot_files(s, d).where("timestamp < '1995-03'")),
    "s34_as_of_view": lambda s, d: snapshots.as_of_view(t.snapshot_files(s, d), t.snapshot_files(s, d), "1995-04-20"),
    "s41_byte_ranges": lambda s, d: _docs(s, d).select("doc_id", F.hex(tree.byte_range(F.col("text").cast("binary"), 5, 7)).alias("middle"), F.hex(tree.byte_range(F.col("text").cast("binary"), -3, 4)).alias("head"), F.hex(tree.byte_range(F.col("text").cast("binary"), 3, -1)).alias("none")),
    "s42_stat": lambda s, d: tree.stat(t.remote_files(s, d), t.remote_files(s, d).where("rel_path is not null").select(F.explode(F.array("rel_path", F.concat(F.lit("/"), F.substring_index("rel_path", "/", 2)), F.concat("rel_path", F.lit("x")))).alias("path")).distinct()),
    "s43_readdir": lambda s, d: tree.readdir(t.remote_files(s, d), "src1/en"),
    "k05_manifest_json": lambda s, d: json_files.manifest(json_files.manifest_json(t.manifest_maps(s, d).where("rel_path is not null")).select(F.to_json(F.create_map("rel_path", F.lit("@"))).alias("k"), "value").select(F.replace("k", F.lit('"@"'), F.col("value")).alias("text"))).select("rel_path", "synced_hash", "synced_remote_hash", F.size("remotes").cast("bigint").alias("n_remotes")),
    "k10_blob_snapshot": lambda s, d: snapshots.blob_snapshot(t.local_files(s, d), t.blobs(s, d)[1], "2026")[1],
    "k14_restored_bodies": lambda s, d: snapshots.checked_bodies(_docs(s, d).select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash")), t.stored_blobs(s, d).select(F.lower("name").alias("h"), "content").groupBy("h").agg(F.max("content").alias("content"))).select("path", "intact"),
    "k15_log_append": lambda s, d: json_files.appended(t.sync_events(s, d), t.sync_events(s, d).where("action = 'click'")).select("ord", "user", "action"),
    "k17_inbox": lambda s, d: json_files.inbox(json_files.inbox_lines(t.sync_events(s, d).select(F.lit("now").alias("timestamp"), F.concat("user", F.lit("!")).alias("title"), F.col("action").alias("message"), "user", "machine")).select(F.col("value").alias("text"))).groupBy("title", "message", "machine").agg(F.count("*").alias("lines")),
    "k22_envelopes_made": lambda s, d: json_files.make_envelopes(_docs(s, d).select(F.concat(F.lit("a\\"), F.col("doc_id").cast("string")).alias("rel_path"), F.col("text").alias("local_text"), F.concat("text", F.lit("\nmore")).alias("remote_text"), F.lit(None).cast("string").alias("base_text"), F.lit(None).cast("string").alias("base_hash"), F.lit("drive").alias("backend")), "/p", "2026").select("path", "local_hash", "remote_hash", "base_hash", "version", (F.length("unified_diff") > 0).alias("differs")),
    "k25_results": lambda s, d: t.remote_files(s, d).where("rel_path is not null").select("rel_path", json_files.envelope_of_result("status", F.struct("rel_path", "size")).alias("json")),
    "k30_hash_cache": lambda s, d: manifest.put_hashes(t.hash_cache(s, d), t.local_times(s, d).where("rel_path like '%/en/%'").select("rel_path", "size", "mtime_ns", F.col("hash").alias("md5"), F.lit(None).cast("string").alias("sha256"))),
    "k31_upsert": lambda s, d: manifest.upsert(_disk(s, d), _held(s, d), _removed(s, d)).select("rel_path", "synced_hash"),
    "p13_snapshot_range": lambda s, d: snapshots.in_range(t.snapshots(s, d).select(F.concat("timestamp", F.lit("T00-00-00Z")).alias("timestamp"), "tag"), "1995-01-10T00-00-00Z", "1995-02-03T00-00-00Z"),
    "p15_active": lambda s, d: log.active(t.sync_events(s, d), _NOW).select("ord"),
    "p16_others": lambda s, d: log.others(t.sync_events(s, d), "m2", "u7").groupBy("user", "machine").agg(F.count("*").alias("events")),
    "p17_other_machines": lambda s, d: log.others(t.sync_events(s, d), "m2").groupBy("machine").agg(F.count("*").alias("events")),
    "p18_well_formed": lambda s, d: log.well_formed(t.sync_events(s, d).select("ord", F.when(F.col("ord") % 5 > 0, F.col("user")).alias("user"), "machine", F.when(F.col("ord") % 7 > 0, F.col("ts")).alias("ts"))).select("ord"),
    "p23_listing_fields": lambda s, d: status.drive_fields(t.remote_files(s, d).select(F.md5("rel_path").alias("id"), F.substring_index("rel_path", "/", -1).alias("name"), "hash", "size")),
    "p24_active_backends": lambda s, d: manifest.active_only(t.manifest_maps(s, d), ["drive", "s3"]).select("rel_path", "n_removed", F.array_join(F.map_keys("remotes"), ",").alias("kept")),
    "p25_pruned_cache": lambda s, d: manifest.prune_cache(t.hash_cache(s, d), t.local_files(s, d)).select("rel_path"),
    "p28_waiting": lambda s, d: manifest.waits(t.manifest_maps(s, d)),
    "j04_upload_plan": lambda s, d: snapshots.upload_plan(t.local_files(s, d), t.blobs(s, d)[1]),
    "j06_downloads": lambda s, d: snapshots.downloads(t.manifest(s, d).select(F.col("rel_path").alias("path"), F.col("synced_hash").alias("hash")), _blob_table(s, d)),
    "j07_migration": lambda s, d: snapshots.migration(_full(s, d), _blobs_snaps(s, d)),
    "j09_retry_queue": lambda s, d: manifest.retry_queue(t.manifest_remotes(s, d)),
    "j10_push_queue": lambda s, d: manifest.expand_queue(_pushed(s, d), manifest.retry_queue(t.manifest_remotes(s, d)), _states(s, d)),
    "j11_latest_diff": lambda s, d: snapshots.diff(t.snapshot_files(s, d), "1995-03", "latest", ["p[13]/*"]),
    "j11_diff_lines": lambda s, d: snapshots.diff_lines(snapshots.diff(t.snapshot_files(s, d), "1995-03", "1995-04"), t.snapshot_files(s, d).where("timestamp = '1995-03'").select("path", F.concat("hash", F.lit("\nsame")).alias("text")), t.snapshot_files(s, d).where("timestamp = '1995-04'").select("path", F.concat("hash", F.lit("\nsame")).alias("text"))),
    "j14_last_foreign_change": lambda s, d: log.last_foreign_change(t.sync_events(s, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), s.range(31).select(F.concat(F.lit("dir3/f"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("id") % 2 == 0, "2024-01-30 12:00:00").alias("since")), "m1"),
    "j15_live_matrix": _matrix,
    "j18_seed_plan": lambda s, d: manifest.seed_plan(t.manifest(s, d), t.manifest_remotes(s, d), t.local_files(s, d), "sftp"),
    "j19_overlay": lambda s, d: manifest.overlay(_settings(s, d, 0), _settings(s, d, 1)),
    "j20_sizes": lambda s, d: snapshots.with_sizes(t.snapshot_files(s, d).where("timestamp = '1995-04'"), t.snapshot_files(s, d).select("hash").distinct().where("hash < 'c'").select("hash", F.lit(9).cast("bigint").alias("size"))),
    "j21_cache_probe": lambda s, d: manifest.probe(t.local_times(s, d), t.hash_cache(s, d)).select("rel_path", "hash"),
    "j22_sha256_probe": lambda s, d: manifest.probe(t.local_times(s, d), t.hash_cache(s, d), "sha256").select("rel_path", "hash"),
    "j23_guard": lambda s, d: manifest.guarded(_pushed(s, d), t.manifest(s, d)),
    "j25_prompt_state": lambda s, d: manifest.prompt_state(t.local_times(s, d), t.manifest_maps(s, d), t.hash_cache(s, d)),
    "a04_conflict_counts": lambda s, d: t.many_files(s, d).select("ord", log.conflict_count(F.when(F.col("ord") % 3 > 0, F.col("resolved"))).alias("conflicts")),
    "a08_tree_counts": lambda s, d: tree.subtree_counts(t.remote_files(s, d)),
    "a15_manifest_phase": lambda s, d: checks.phase_counts(checks.manifest_findings(t.manifest(s, d), *_remotes_with_live(s, d), t.BACKENDS), "manifest"),
    "a16_blob_findings": lambda s, d: checks.blob_findings(t.stored_blobs(s, d)).groupBy("backend", "finding").agg(F.count("*").alias("n")),
    "a18_verify": _verify,
    "a19_health": lambda s, d: checks.health(mirrors.backend_status(t.manifest_remotes(s, d)).select(F.when(F.col("status") == "pending", "warn").when(F.col("status") == "failed", "unsupported").otherwise("ok").alias("status")).union(t.manifest_remotes(s, d).where("state = 'pending_retry'").select(F.lit("warn")))),
    "a20_last_sync_age": _health,
    "a23_tags": lambda s, d: snapshots.tags(t.snapshots(s, d)),
    "a24_tagged": lambda s, d: snapshots.tagged(t.snapshots(s, d).withColumn("tag", F.when(F.col("timestamp").endswith("-05"), "five").otherwise(F.col("tag"))), s.range(3).select(F.element_at(F.array(F.lit("five"), F.lit("v1995"), F.lit("gone")), (F.col("id") + 1).cast("int")).alias("tag"))),
    "a27_summary": lambda s, d: checks.summary(_states(s, d)),
    "a28_listing_totals": lambda s, d: tree.totals(t.remote_files(s, d)),
    "a29_quarantine_alerts": lambda s, d: manifest.quarantine_alerts(t.manifest_remotes(s, d)),
    "a31_seed_counts": lambda s, d: manifest.seed_counts(manifest.seed_plan(t.manifest(s, d), t.manifest_remotes(s, d), t.local_files(s, d), "sftp")),
    "w02_transitions": lambda s, d: snapshots.transitions(snapshots.versions(t.snapshot_files(s, d), dealt=True)),
    "w07_forget_before": lambda s, d: snapshots.forget(t.snapshots(s, d).select(F.concat("timestamp", F.lit("T00-00-00Z")).alias("timestamp"), "tag"), before="1995-05-01T00-00-00Z"),
    "w07_keep_last": lambda s, d: snapshots.forget(t.snapshots(s, d), keep_last=400),
    "w08_forget_named": lambda s, d: snapshots.forget(t.snapshots(s, d), timestamps=["1995-01-01", "1995-01-02", "2222"]),
    "w09_evicted": lambda s, d: snapshots.evicted(_cache(s, d), 1_000_000),
    "n03_capped_resolved": lambda s, d: t.many_files(s, d).select("ord", F.element_at(json_files.capped_resolved(F.col("resolved")), -1).alias("l")).select("ord", "l.path", "l.strategy"),
    "n05_tree_rank": lambda s, d: tree.tree_rank(t.remote_files(s, d)),
    "n07_subtree": lambda s, d: tree.subtree(t.remote_files(s, d), "/src1/en/").select("rel_path"),
    "n09_log_tail": lambda s, d: log.tail(t.sync_events(s, d)).select("ord", "user", "action"),
    "n12_guarded_listing": lambda s, d: tree.guarded_listing(t.remote_files(s, d)).select("rel_path"),
    "u03_formats": lambda s, d: snapshots.union_formats(_full(s, d), _blobs_snaps(s, d)),
    "u06_referenced": lambda s, d: snapshots.referenced(t.snapshot_files(s, d)),
    "u07_conflicts": lambda s, d: status.conflicts(_states(s, d), manifest.guarded(_pushed(s, d), t.manifest(s, d))),
    "u08_times": lambda s, d: snapshots.times(t.snapshot_files(s, d)),
    "t11_attempts": lambda s, d: manifest.attempts(t.outcomes(s, d)),
    "t12_after_success": lambda s, d: manifest.after_success(t.manifest_maps(s, d), t.local_files(s, d).where("rel_path like '%3.md'").select("rel_path", F.col("hash").alias("synced_hash"), F.lit("new").alias("remote_file_id"), F.lit("2027").alias("synced_at"), F.lit("r").alias("synced_remote_hash"))).select("rel_path", "synced_hash", "remote_file_id", "synced_at", "synced_remote_hash", F.size("remotes").cast("bigint").alias("n_remotes")),
    "t13_after_pull": lambda s, d: manifest.after_pull(t.remote_files(s, d).where("rel_path like '%/fr/%'"), ["dropbox", "sftp"]),
    "t14_fan_out": lambda s, d: manifest.fan_out(t.manifest_remotes(s, d).select("rel_path", "backend", F.when(F.col("ord") % 5 == 0, "auth").when(F.col("ord") % 5 == 1, "transient").when(F.col("ord") % 5 == 2, "rate_limit_global").alias("error_class"))).groupBy("backend", "state").agg(F.count("*").alias("files")),
    "t20_log_once": lambda s, d: log.once(t.sync_events(s, d).union(t.sync_events(s, d).withColumn("ord", F.col("ord") + 100_000))).select("ord", "user", "machine", "action"),
}

_TIMES = """
lt AS (SELECT rel_path, size, doc_id * 1000 AS mtime_ns, CASE WHEN doc_id % 7 = 0 THEN md5(h || 'L') ELSE h END AS hash FROM base WHERE doc_id % 10 <> 1 AND rel_path IS NOT NULL),
cache AS (SELECT rel_path, size, doc_id * 1000 + (doc_id % 9 = 0)::INT AS mtime_ns, h AS md5, CASE WHEN doc_id % 5 = 0 THEN '' ELSE sha256(h) END AS sha256 FROM base WHERE doc_id % 4 <> 1 AND rel_path IS NOT NULL)"""
_FILES_SNAP = f"WITH {_SNAPS}"
_MAN2 = "man AS (SELECT rel_path, h AS synced_hash, CASE WHEN doc_id % 2 = 0 THEN '' ELSE h END AS synced_remote_hash FROM base WHERE doc_id % 13 <> 1 AND rel_path IS NOT NULL)"
_PUSHED = f"{_MAN2}, pushed AS (SELECT rel_path, remote_hash FROM states WHERE status IN ('local_ahead', 'new_local')), guarded AS (SELECT p.rel_path, NOT coalesce(m.rel_path IS NOT NULL AND coalesce(remote_hash, '') <> '' AND remote_hash IS DISTINCT FROM coalesce(nullif(synced_remote_hash, ''), synced_hash), false) AS safe FROM pushed p LEFT JOIN man m USING (rel_path))"
_SEED = "seed AS (SELECT m.rel_path, CASE WHEN l.rel_path IS NULL THEN 'failed' WHEN synced_hash <> '' AND l.hash IS DISTINCT FROM synced_hash THEN 'skipped_drift' ELSE 'seed' END AS action FROM manifest m LEFT JOIN local_files l USING (rel_path) WHERE m.rel_path NOT IN (SELECT rel_path FROM remotes WHERE backend = 'sftp'))"
_FOUND = """live AS (SELECT rel_path, backend, CASE WHEN ord % 17 = 0 THEN 'other' ELSE remote_hash END AS hash FROM remotes WHERE ord % 19 <> 0),
found AS (SELECT b.backend, CASE WHEN coalesce(state, '') <> 'ok' THEN 'verified' WHEN live.hash IS NULL THEN 'missing' WHEN remote_hash <> '' AND remote_hash <> live.hash THEN 'drift' ELSE 'verified' END AS finding
  FROM manifest m CROSS JOIN (VALUES ('drive'), ('dropbox'), ('sftp')) b(backend) LEFT JOIN remotes r ON r.rel_path = m.rel_path AND r.backend = b.backend LEFT JOIN live ON live.rel_path = m.rel_path AND live.backend = b.backend)"""
_BLOBS = """blob AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'drive' ELSE 'sftp' END AS backend, CASE WHEN doc_id % 13 = 0 AND regexp_matches(sha256(text), '[a-f]') THEN 'corrupted' WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'corrupted' ELSE 'verified' END AS finding FROM documents)"""
_COUNTED = "count(*) AS checked, count(*) FILTER (finding = 'verified') AS verified, count(*) FILTER (finding = 'drift') AS drift, count(*) FILTER (finding = 'missing') AS missing, count(*) FILTER (finding = 'corrupted') AS corrupted"
_OUTCOMES = """o AS (SELECT 'f' || (user_id % 40) AS rel_path, CASE WHEN user_id % 2 = 0 THEN 'sftp' ELSE 'drive' END AS backend, event_id AS ord, CASE WHEN event_id % 23 = 0 THEN 'ok' WHEN event_id % 11 = 0 THEN 'failed_perm' ELSE 'pending_retry' END AS state,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE 'h' || (event_id // 2500) END AS hash FROM events)"""

ORACLE_SQL = {
    "s17_manifest_files": f"""WITH {_FILES} SELECT rel_path, h AS synced_hash, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END || doc_id AS remote_file_id, '' AS synced_at, CASE WHEN doc_id % 2 = 0 THEN h ELSE '' END AS synced_remote_hash, (doc_id % 2)::BIGINT AS n_remotes,
        CASE WHEN doc_id % 2 = 1 THEN 'failed_perm' END AS sftp, CASE WHEN doc_id % 2 = 1 THEN doc_id % 4 END AS attempts FROM base WHERE doc_id % 17 <> 0 AND NOT starts_with(rel_path, 'src3/')""",
    "s19_cache_files": f"WITH {_FILES}, {_TIMES} SELECT rel_path, size, mtime_ns, md5, sha256 FROM cache",
    "s20_catalogue": f"""{_FILES_SNAP}, n AS (SELECT timestamp, 'full' AS format, tag FROM snaps WHERE timestamp < '1995-06' UNION ALL SELECT timestamp, 'blobs', tag FROM snaps WHERE timestamp >= '1995-03'), g AS (SELECT *, NOT suffix(timestamp, '-15') AS fine FROM n)
        SELECT timestamp, format, CASE WHEN fine THEN 'me@pc' ELSE '' END AS triggered_by, CASE WHEN NOT fine THEN '' WHEN timestamp < '1995' THEN 'push' ELSE 'sync' END AS action, (3 * fine::INT)::BIGINT AS total_files, CASE WHEN fine THEN tag END AS tag, fine::BIGINT AS changed FROM g""",
    "s21_source_of_snapshots": f"""{_FILES_SNAP}, c AS (SELECT timestamp, backend, p, CASE WHEN day(timestamp::DATE) % 2 = 0 THEN 'blobs' ELSE 'full' END AS format FROM snaps, (VALUES (0, 'drive'), (1, 'dropbox'), (2, 'sftp')) v(p, backend) WHERE day(timestamp::DATE) % 3 <= p)
        SELECT timestamp, arg_min(backend, p) AS backend, arg_min(format, p) AS format FROM c GROUP BY 1""",
    "s22_snapshot_files": f"{_FILES_SNAP} SELECT timestamp, path, hash FROM files",
    "s23_full_files": f"{_FILES_SNAP} SELECT timestamp, path, md5(path) AS id, CASE WHEN length(path) > 5 THEN length(path) ELSE 0 END AS size FROM files WHERE path <> 'p1/f1'",
    "s24_identifiers": f"{_FILES_SNAP} SELECT path, hash AS identifier FROM files WHERE timestamp = '1995-04'",
    "s25_blob_bodies": "SELECT sha256(text) AS h, bool_or(doc_id % 2 = 0 AND doc_id % 13 <> 0 AND doc_id % 11 <> 0) AS stored FROM documents GROUP BY 1",
    "s26_log_files": f"""WITH {_LOG} SELECT machine, row_number() OVER (PARTITION BY machine ORDER BY ord) - 1 AS ord, "user", strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, action, array_to_string(files, '|') AS files, 0::BIGINT AS resolved FROM log""",
    "s27_messages": f"""WITH {_LOG} SELECT "user", machine, strftime(ts, '%Y-%m-%d') AS timestamp, action, count(*) AS events FROM log WHERE ord % 9 <> 0 AND ord % 4 > 0 GROUP BY 1, 2, 3, 4""",
    "s29_envelopes": "SELECT doc_id::VARCHAR AS path, text AS local_text, 'r' AS remote_text FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 5 > 0 AND doc_id % 3 = 1",
    "s31_frozen_view": f"{_FILES_SNAP} SELECT path AS rel_path, hash AS identifier, CASE WHEN hash < 'c' THEN 32 ELSE 0 END::BIGINT AS size FROM files WHERE timestamp = '1995-04'",
    "s32_mirror_view": f"WITH {_FILES} SELECT rel_path, state FROM remotes WHERE backend = 'sftp'",
    "s33_all_view": f"{_FILES_SNAP} SELECT timestamp || '/' || path AS rel_path, hash AS identifier FROM files WHERE timestamp < '1995-03'",
    "s34_as_of_view": f"{_FILES_SNAP} SELECT path AS rel_path, hash AS identifier FROM files WHERE timestamp = '1995-04'",
    "s42_stat": f"""WITH {_FILES}, a AS (SELECT DISTINCT unnest([rel_path, '/' || split_part(rel_path, '/', 1) || '/' || split_part(rel_path, '/', 2), rel_path || 'x']) AS path FROM remote_files)
        SELECT path, CASE WHEN size IS NOT NULL THEN 'file' WHEN path[1] = '/' THEN 'dir' END AS kind, size FROM a LEFT JOIN remote_files ON rel_path = path""",
    "s43_readdir": f"WITH {_FILES} SELECT unnest(['.', '..']) AS name UNION SELECT split_part(rel_path, '/', 3) FROM remote_files WHERE starts_with(rel_path, 'src1/en/')",
    "k05_manifest_json": f"WITH {_FILES}, {_MAN2} SELECT rel_path, synced_hash, synced_remote_hash, (SELECT count(*) FROM remotes r WHERE r.rel_path = m.rel_path) AS n_remotes FROM man m",
    "k10_blob_snapshot": f"WITH {_FILES} SELECT DISTINCT hash AS h FROM local_files WHERE hash NOT IN (SELECT h FROM base WHERE doc_id % 3 <> 0)",
    "k14_restored_bodies": "SELECT doc_id::VARCHAR AS path, bool_and(doc_id % 11 = 0 OR doc_id % 7 <> 0) OVER w AND bool_or(doc_id % 11 <> 0 AND doc_id % 7 <> 0) OVER w AS intact FROM documents WINDOW w AS (PARTITION BY sha256(text))",
    "k15_log_append": f"""WITH {_LOG} SELECT ord, "user", action FROM (SELECT ord, "user", action FROM log UNION ALL SELECT ord + (SELECT max(ord) + 1 FROM log), "user", action FROM log WHERE action = 'click') ORDER BY ord DESC LIMIT 200""",
    "s41_byte_ranges": "SELECT doc_id, hex(encode(text)[6:12]) AS middle, hex(encode(text)[1:4]) AS head, '' AS none FROM documents",
    "k17_inbox": f"""WITH {_LOG} SELECT "user" || '!' AS title, action AS message, machine, count(*) AS lines FROM log GROUP BY 1, 2, 3""",
    "k22_envelopes_made": "SELECT 'a/' || doc_id AS path, sha256(text) AS local_hash, sha256(text || chr(10) || 'more') AS remote_hash, NULL::VARCHAR AS base_hash, 1 AS version, true AS differs FROM documents",
    "k25_results": f"""WITH {_FILES} SELECT rel_path, '{{"version":1,"command":"status","result":{{"rel_path":"' || rel_path || '","size":' || size || '}}}}' AS json FROM remote_files""",
    "k30_hash_cache": f"""WITH {_FILES}, {_TIMES}, n AS (SELECT * FROM lt WHERE rel_path LIKE '%/en/%') SELECT coalesce(n.rel_path, c.rel_path) AS rel_path, coalesce(n.size, c.size) AS size, coalesce(n.mtime_ns, c.mtime_ns) AS mtime_ns, coalesce(n.hash, c.md5) AS md5,
        CASE WHEN n.rel_path IS NULL OR n.size = c.size AND n.mtime_ns = c.mtime_ns THEN c.sha256 ELSE '' END AS sha256 FROM cache c FULL JOIN n ON n.rel_path = c.rel_path""",
    "k31_upsert": f"""WITH {_FILES} SELECT rel_path, CASE WHEN rel_path LIKE '%/en/%' THEN reverse(synced_hash) ELSE synced_hash END AS synced_hash FROM manifest WHERE rel_path NOT LIKE '%/de/%'
        UNION ALL SELECT 'new/' || rel_path, hash FROM local_files WHERE rel_path LIKE '%1.md'""",
    "p13_snapshot_range": f"{_FILES_SNAP} SELECT timestamp || 'T00-00-00Z' AS timestamp, tag FROM snaps WHERE timestamp BETWEEN '1995-01-10' AND '1995-02-03'",
    "p15_active": f"WITH {_LOG} SELECT ord FROM log WHERE ts >= TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR",
    "p16_others": f"""WITH {_LOG} SELECT "user", machine, count(*) AS events FROM log WHERE NOT ("user" = 'u7' AND machine = 'm2') GROUP BY 1, 2""",
    "p17_other_machines": f"WITH {_LOG} SELECT machine, count(*) AS events FROM log WHERE machine <> 'm2' GROUP BY 1",
    "p18_well_formed": f"WITH {_LOG} SELECT ord FROM log WHERE ord % 5 > 0 AND ord % 7 > 0",
    "p23_listing_fields": f"WITH {_FILES} SELECT md5(rel_path) AS id, string_split(rel_path, '/')[-1] AS name, hash FROM remote_files",
    "p24_active_backends": f"WITH {_FILES} SELECT rel_path, (SELECT count(*) FROM remotes r WHERE r.rel_path = m.rel_path AND backend <> 'drive') AS n_removed, CASE WHEN EXISTS (FROM remotes r WHERE r.rel_path = m.rel_path AND backend = 'drive') THEN 'drive' ELSE '' END AS kept FROM manifest m",
    "p25_pruned_cache": f"WITH {_FILES}, {_TIMES} SELECT rel_path FROM cache WHERE rel_path IN (SELECT rel_path FROM local_files)",
    "p28_waiting": f"WITH {_FILES} SELECT rel_path, rel_path IN (SELECT rel_path FROM remotes WHERE state = 'pending_retry') AS waits FROM manifest",
    "j04_upload_plan": f"WITH {_FILES} SELECT DISTINCT hash AS h, hash NOT IN (SELECT h FROM base WHERE doc_id % 3 <> 0) AS upload FROM local_files",
    "j06_downloads": f"WITH {_FILES} SELECT rel_path AS path, synced_hash AS hash, CASE WHEN synced_hash IN (SELECT h FROM base WHERE doc_id % 3 <> 0) THEN 'b' || synced_hash END AS id FROM manifest",
    "j07_migration": f"{_FILES_SNAP} SELECT timestamp, CASE WHEN timestamp >= '1995-03' THEN 'orphan' ELSE 'convert' END AS action FROM snaps WHERE timestamp < '1995-06'",
    "j09_retry_queue": f"WITH {_FILES} SELECT DISTINCT rel_path FROM remotes WHERE state = 'pending_retry' ORDER BY 1 LIMIT 200",
    "j10_push_queue": f"WITH {_FILES}, {_PUSHED}, w AS (SELECT DISTINCT rel_path FROM remotes WHERE state = 'pending_retry' ORDER BY 1 LIMIT 200) SELECT rel_path FROM pushed UNION ALL SELECT rel_path FROM w WHERE rel_path NOT IN (SELECT rel_path FROM pushed) AND rel_path IN (SELECT rel_path FROM states)",
    "j11_latest_diff": f"""{_FILES_SNAP} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.hash IS NOT DISTINCT FROM b.hash THEN 'unchanged' ELSE 'modified' END AS change
        FROM (SELECT * FROM files WHERE timestamp = '1995-03' AND path[2] IN ('1', '3') AND path[3] = '/') a FULL JOIN (SELECT * FROM files WHERE timestamp = (SELECT max(timestamp) FROM files) AND path[2] IN ('1', '3') AND path[3] = '/') b ON a.path = b.path""",
    "j11_diff_lines": f"""{_FILES_SNAP}, x AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'modified' END AS change
        FROM (SELECT * FROM files WHERE timestamp = '1995-03') a FULL JOIN (SELECT * FROM files WHERE timestamp = '1995-04') b ON a.path = b.path)
        SELECT path, change, CASE change WHEN 'added' THEN 2 WHEN 'modified' THEN 1 ELSE 0 END::BIGINT AS added, CASE change WHEN 'removed' THEN 2 WHEN 'modified' THEN 1 ELSE 0 END::BIGINT AS removed FROM x""",
    "j14_last_foreign_change": f"""WITH {_LOG}, e AS (SELECT ord, "user", machine, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, unnest(files) AS path FROM log WHERE machine <> 'm1'), l AS (SELECT * FROM e WHERE (path, ord) IN (SELECT path, max(ord) FROM e GROUP BY 1))
        SELECT DISTINCT l.path, "user", machine, ts FROM l JOIN (SELECT 'dir3/f' || i || '.md' AS path, CASE WHEN i % 2 = 0 THEN '2024-01-30 12:00:00' END AS since FROM range(31) r(i)) p ON p.path = l.path WHERE since IS NULL OR ts > since""",
    "j15_live_matrix": f"""WITH {_FILES}, x AS (SELECT coalesce(m.rel_path, l.rel_path) AS rel_path, m.rel_path IS NOT NULL AS known, synced_hash, l.hash FROM manifest m FULL JOIN local_files l ON l.rel_path = m.rel_path),
        c AS (SELECT x.rel_path, b.backend, CASE WHEN state = 'pending_retry' THEN 'pending' WHEN state = 'failed_perm' THEN 'failed' WHEN NOT known THEN 'new local' WHEN state IS NULL THEN 'unseeded' WHEN ord % 19 = 0 THEN 'absent' WHEN hash IS NULL THEN 'deleted' WHEN hash <> synced_hash THEN 'local ahead' ELSE 'ok' END AS cell
          FROM x CROSS JOIN (VALUES ('drive'), ('dropbox'), ('sftp')) b(backend) LEFT JOIN remotes r ON r.rel_path = x.rel_path AND r.backend = b.backend)
        SELECT rel_path, max(cell) FILTER (backend = 'drive') AS drive, max(cell) FILTER (backend = 'dropbox') AS dropbox, max(cell) FILTER (backend = 'sftp') AS sftp FROM c GROUP BY 1""",
    "j18_seed_plan": f"WITH {_FILES}, {_SEED} SELECT * FROM seed",
    "j19_overlay": """WITH k AS (SELECT i, 'k' || i AS key, s, CASE (i + s) % 5 WHEN 0 THEN 'false' WHEN 1 THEN '""' WHEN 2 THEN 'v' || s || '-' || i WHEN 3 THEN '0' ELSE '[1]' END AS value FROM (SELECT c_custkey AS i FROM customer), range(2) q(s) WHERE i % 7 <> s)
        SELECT coalesce(a.key, b.key) AS key, coalesce(CASE WHEN a.value NOT IN ('false', '""', '0') THEN a.value END, b.value, a.value) AS value FROM (FROM k WHERE s = 0) a FULL JOIN (FROM k WHERE s = 1) b ON a.key = b.key""",
    "j20_sizes": f"{_FILES_SNAP} SELECT path, hash, CASE WHEN hash < 'c' THEN 9 ELSE 0 END::BIGINT AS size FROM files WHERE timestamp = '1995-04'",
    "j21_cache_probe": f"WITH {_FILES}, {_TIMES} SELECT l.rel_path, md5 AS hash FROM lt l LEFT JOIN cache c ON c.rel_path = l.rel_path AND c.size = l.size AND c.mtime_ns = l.mtime_ns",
    "j22_sha256_probe": f"WITH {_FILES}, {_TIMES} SELECT l.rel_path, nullif(sha256, '') AS hash FROM lt l LEFT JOIN cache c ON c.rel_path = l.rel_path AND c.size = l.size AND c.mtime_ns = l.mtime_ns",
    "j23_guard": f"WITH {_FILES}, {_PUSHED} SELECT * FROM guarded",
    "j25_prompt_state": f"""WITH {_FILES}, {_TIMES}, p AS (SELECT count(*) FILTER (coalesce(synced_hash, '') = '' OR md5 IS NULL OR md5 <> synced_hash) AS a FROM lt l LEFT JOIN cache c ON c.rel_path = l.rel_path AND c.size = l.size AND c.mtime_ns = l.mtime_ns LEFT JOIN manifest m ON m.rel_path = l.rel_path),
        q AS (SELECT count(DISTINCT rel_path) AS c FROM remotes WHERE state = 'pending_retry') SELECT a AS local_ahead, 0::BIGINT AS remote_ahead, c AS conflicts, a + c = 0 AS in_sync FROM p, q""",
    "a04_conflict_counts": f"WITH {_LOG} SELECT ord, CASE WHEN ord % 3 > 0 THEN 95 + ord % 20 ELSE 0 END AS conflicts FROM log",
    "a08_tree_counts": f"""WITH {_FILES}, p AS (SELECT string_split(rel_path, '/') AS p, size FROM remote_files), u AS (SELECT array_to_string(p[1:i], '/') AS prefix, i, p, size FROM p, LATERAL (SELECT unnest(range(0, len(p))) AS i)),
        s AS (SELECT prefix, count(*) AS files, sum(size)::BIGINT AS bytes FROM u GROUP BY 1), f AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS prefix, i FROM u WHERE i > 0),
        d AS (SELECT array_to_string(string_split(prefix, '/')[1:j], '/') AS prefix, count(*) AS dirs FROM f, LATERAL (SELECT unnest(range(0, i)) AS j) GROUP BY 1) SELECT s.prefix, coalesce(dirs, 0) AS dirs, files, bytes FROM s LEFT JOIN d USING (prefix)""",
    "a15_manifest_phase": f"WITH {_FILES}, {_FOUND} SELECT 'manifest' AS phase, {_COUNTED} FROM found",
    "a16_blob_findings": f"WITH {_BLOBS} SELECT backend, finding, count(*) AS n FROM blob GROUP BY 1, 2",
    "a18_verify": f"""WITH {_FILES}, {_FOUND}, {_BLOBS}, c AS (SELECT 'manifest' AS phase, {_COUNTED} FROM found UNION ALL SELECT 'snapshots', {_COUNTED} FROM blob UNION ALL SELECT 'cache', {_COUNTED} FROM (SELECT CASE WHEN finding = 'missing' THEN 'corrupted' ELSE finding END AS finding FROM blob WHERE backend = 'drive'))
        SELECT *, drift + missing + corrupted > 0 AS findings FROM c""",
    "a19_health": f"WITH {_FILES} SELECT CASE WHEN count(*) FILTER (state = 'pending_retry') > 0 THEN 'warn' ELSE 'ok' END AS status FROM remotes",
    "a20_last_sync_age": f"WITH {_LOG}, l AS (SELECT arg_max(ts, ord) AS t FROM log), h AS (SELECT date_diff('second', t, TIMESTAMP '2024-02-03') / 3600 AS h FROM l) SELECT 'last_sync_age' AS name, CASE WHEN h > 72 THEN 'fail' WHEN h > 24 THEN 'warn' ELSE 'ok' END AS status FROM h UNION ALL SELECT 'last_sync_age', 'ok'",
    "a23_tags": f"{_FILES_SNAP} SELECT DISTINCT tag FROM snaps WHERE tag <> ''",
    "a24_tagged": f"{_FILES_SNAP} SELECT 'five' AS tag, max(timestamp) AS timestamp FROM snaps WHERE suffix(timestamp, '-05') UNION ALL SELECT 'v1995', max(timestamp) FROM snaps WHERE tag = 'v1995' UNION ALL SELECT 'gone', NULL",
    "a27_summary": f"""WITH {_FILES} SELECT count(*) FILTER (status = 'in_sync') AS in_sync, count(*) FILTER (status IN ('local_ahead', 'new_local')) AS to_push, count(*) FILTER (status IN ('remote_ahead', 'new_remote')) AS to_pull,
        count(*) FILTER (status = 'conflict') AS conflicts, count(*) FILTER (status = 'deleted_local') AS deleted, count(*) AS total FROM states""",
    "a28_listing_totals": f"WITH {_FILES} SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM remote_files",
    "a29_quarantine_alerts": f"WITH {_FILES} SELECT backend, count(DISTINCT rel_path) AS files, arg_max(last_error, ord) AS last_error FROM remotes WHERE state = 'failed_perm' GROUP BY 1",
    "a31_seed_counts": f"WITH {_FILES}, {_SEED} SELECT count(*) AS total, count(*) FILTER (action = 'seed') AS seeded, count(*) FILTER (action = 'skipped_drift') AS skipped_drift, count(*) FILTER (action = 'failed') AS failed FROM seed",
    "w02_transitions": f"""{_FILES_SNAP}, firsts AS (SELECT path, hash, min(timestamp) AS first FROM files GROUP BY 1, 2), n AS (SELECT path, hash, row_number() OVER (PARTITION BY path ORDER BY first, hash) AS v FROM firsts), x AS (SELECT path, timestamp, 'v' || v AS version FROM files JOIN n USING (path, hash))
        SELECT *, version IS DISTINCT FROM lag(version) OVER (PARTITION BY path ORDER BY timestamp DESC) AS changed FROM x""",
    "w07_forget_before": f"{_FILES_SNAP} SELECT timestamp || 'T00-00-00Z' AS timestamp FROM snaps WHERE timestamp < '1995-05-01' AND tag IS NULL",
    "w07_keep_last": f"{_FILES_SNAP} SELECT timestamp FROM snaps WHERE tag IS NULL AND timestamp NOT IN (SELECT timestamp FROM snaps ORDER BY 1 DESC LIMIT 400)",
    "w08_forget_named": f"{_FILES_SNAP} SELECT timestamp FROM snaps WHERE timestamp IN ('1995-01-01', '1995-01-02', '2222')",
    "w09_evicted": """SELECT name FROM (SELECT doc_id::VARCHAR AS name, coalesce(sum(n_chars) OVER (ORDER BY doc_id * 37 % 5000, doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_chars) OVER () AS total FROM documents) WHERE total - before > 1000000""",
    "n03_capped_resolved": f"WITH {_LOG} SELECT ord, CASE WHEN ord % 20 > 5 THEN '... and ' || (ord % 20 - 5) || ' more' ELSE 'f' || (95 + ord % 20) END AS path, CASE WHEN ord % 20 > 5 THEN '' ELSE 'keep-local' END AS strategy FROM log",
    "n05_tree_rank": f"""WITH {_FILES}, e AS (SELECT array_to_string(p[1:i], '/') AS parent, p[i + 1] AS name, bool_or(i + 1 < len(p)) AS is_dir FROM (SELECT string_split(rel_path, '/') AS p FROM remote_files), LATERAL (SELECT unnest(range(0, len(p))) AS i) GROUP BY 1, 2)
        SELECT CASE WHEN parent = '' THEN name ELSE parent || '/' || name END AS prefix, is_dir, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, lower(name), name) AS rank FROM e""",
    "n07_subtree": f"WITH {_FILES} SELECT rel_path FROM remote_files WHERE starts_with(rel_path, 'src1/en/')",
    "n09_log_tail": f"""WITH {_LOG} SELECT ord, "user", action FROM log ORDER BY ord DESC LIMIT 20""",
    "n12_guarded_listing": f"WITH {_FILES} SELECT rel_path FROM remote_files",
    "u03_formats": f"{_FILES_SNAP} SELECT timestamp, 'full' AS format FROM snaps WHERE timestamp < '1995-06' UNION ALL SELECT timestamp, 'blobs' FROM snaps WHERE timestamp >= '1995-03'",
    "u06_referenced": f"{_FILES_SNAP} SELECT DISTINCT hash AS h FROM files",
    "u07_conflicts": f"WITH {_FILES}, {_PUSHED} SELECT rel_path FROM states WHERE status = 'conflict' UNION SELECT rel_path FROM guarded WHERE NOT safe",
    "u08_times": f"{_FILES_SNAP} SELECT DISTINCT timestamp FROM files",
    "t11_attempts": f"""WITH {_OUTCOMES}, r AS (SELECT *, CASE WHEN state = 'ok' OR hash <> '' AND hash <> lag(hash, 1, '') OVER (PARTITION BY rel_path, backend ORDER BY ord) THEN 1 ELSE 0 END AS starts FROM o),
        g AS (SELECT *, sum(starts) OVER (PARTITION BY rel_path, backend ORDER BY ord) AS run FROM r),
        n AS (SELECT *, row_number() OVER w - (first_value(state) OVER w = 'ok')::INT AS attempts FROM g WINDOW w AS (PARTITION BY rel_path, backend, run ORDER BY ord))
        SELECT rel_path, backend, ord, CASE WHEN state = 'pending_retry' AND attempts >= 10 THEN 'failed_perm' ELSE state END AS state, attempts FROM n""",
    "t12_after_success": f"""WITH {_FILES}, {_MAN2}, n AS (SELECT rel_path, hash FROM local_files WHERE rel_path LIKE '%3.md') SELECT coalesce(n.rel_path, m.rel_path) AS rel_path, coalesce(n.hash, synced_hash) AS synced_hash, CASE WHEN n.rel_path IS NULL THEN 'id' ELSE 'new' END AS remote_file_id,
        CASE WHEN n.rel_path IS NULL THEN '2026-05-01' ELSE '2027' END AS synced_at, CASE WHEN n.rel_path IS NULL THEN synced_remote_hash ELSE 'r' END AS synced_remote_hash, CASE WHEN m.rel_path IS NOT NULL THEN (SELECT count(*) FROM remotes r WHERE r.rel_path = m.rel_path) END AS n_remotes FROM man m FULL JOIN n ON n.rel_path = m.rel_path""",
    "t13_after_pull": f"WITH {_FILES} SELECT rel_path, backend, 'pending_retry' AS state, hash AS intended_hash FROM remote_files CROSS JOIN (VALUES ('dropbox'), ('sftp')) v(backend) WHERE rel_path LIKE '%/fr/%'",
    "t14_fan_out": f"WITH {_FILES} SELECT backend, CASE ord % 5 WHEN 0 THEN 'failed_perm' WHEN 1 THEN 'pending_retry' WHEN 2 THEN 'pending_retry' ELSE 'ok' END AS state, count(*) AS files FROM remotes GROUP BY 1, 2",
    "t20_log_once": f"""WITH {_LOG} SELECT ord, "user", machine, action FROM log""",
}
