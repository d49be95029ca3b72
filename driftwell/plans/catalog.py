"""Registered queries over the file-state tables and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions import rules, text
from driftwell.operators import log, mirrors, snapshots, status, tree
from driftwell.sources import json_files
from driftwell.sources import tables as t

_FILES = """
base AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.md' AS rel_path, n_chars AS size, md5(text) AS h FROM documents),
local_files AS (SELECT rel_path, size, CASE WHEN doc_id % 7 = 0 THEN md5(h || 'L') ELSE h END AS hash FROM base WHERE doc_id % 10 <> 1 AND rel_path IS NOT NULL),
remote_files AS (SELECT rel_path, size, CASE WHEN doc_id % 5 = 0 THEN md5(h || 'R') ELSE h END AS hash FROM base WHERE doc_id % 11 <> 1 AND rel_path IS NOT NULL),
manifest AS (SELECT rel_path, h AS synced_hash FROM base WHERE doc_id % 13 <> 1 AND rel_path IS NOT NULL),
remotes AS (
  SELECT rel_path, backend, doc_id AS ord, (doc_id + n) % 6 AS k, CASE (doc_id + n) % 6 WHEN 1 THEN 'pending_retry' WHEN 2 THEN 'failed_perm' ELSE 'ok' END AS state,
         CASE WHEN doc_id % 17 = 0 THEN md5(h) ELSE h END AS remote_hash, CASE WHEN (doc_id + n) % 6 IN (1, 2) THEN 'error ' || (doc_id % 4) END AS last_error
  FROM base, (VALUES (0, 'drive'), (1, 'dropbox'), (2, 'sftp')) v(n, backend) WHERE doc_id % 13 <> 1 AND (doc_id + n) % 6 <> 0
),
states AS (
  SELECT rel_path, l.size AS local_size, r.size AS remote_size, l.hash AS local_hash, r.hash AS remote_hash,
    CASE WHEN NOT on_m AND on_l AND on_r THEN 'conflict' WHEN NOT on_m AND on_l THEN 'new_local' WHEN NOT on_m THEN 'new_remote' WHEN NOT on_l THEN 'deleted_local'
         WHEN cl AND cr THEN 'conflict' WHEN cl THEN 'local_ahead' WHEN cr THEN 'remote_ahead' ELSE 'in_sync' END AS status
  FROM (SELECT rel_path FROM local_files UNION SELECT rel_path FROM remote_files UNION SELECT rel_path FROM manifest) u
  LEFT JOIN local_files l USING (rel_path) LEFT JOIN remote_files r USING (rel_path) LEFT JOIN manifest m USING (rel_path),
  LATERAL (SELECT l.rel_path IS NOT NULL AS on_l, r.rel_path IS NOT NULL AS on_r, m.rel_path IS NOT NULL AS on_m,
    l.hash IS DISTINCT FROM m.synced_hash AS cl, r.rel_path IS NOT NULL AND r.hash IS DISTINCT FROM m.synced_hash AS cr) x
)"""
_LOG = """
log AS (
  SELECT event_id AS ord, 'u' || user_id AS "user", 'm' || (user_id % 5) AS machine, event_type AS action, ts, (event_id % 10 = 0)::BIGINT AS conflicts,
         list_transform(range(1, 2 + event_id % 3), lambda i: 'dir' || ((event_id + i) % 7) || '/f' || ((event_id * i) % 31) || '.md') AS files
  FROM events
)"""
_SNAPS = """
snaps AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS timestamp, CASE WHEN strftime(o_orderdate, '%m-%d') = '01-01' THEN 'v' || strftime(o_orderdate, '%Y') END AS tag FROM orders),
files AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS timestamp, 'p' || (l_partkey % 10) || '/f' || l_partkey AS path, min(md5(l_returnflag || l_linestatus)) AS hash
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
),
keep AS (
  (SELECT timestamp FROM snaps ORDER BY 1 DESC LIMIT 3)
  UNION (SELECT max(timestamp) FROM snaps GROUP BY timestamp[1:10] ORDER BY 1 DESC LIMIT 5)
  UNION (SELECT max(timestamp) FROM snaps GROUP BY timestamp[1:7] ORDER BY 1 DESC LIMIT 4)
  UNION (SELECT max(timestamp) FROM snaps GROUP BY timestamp[1:4] ORDER BY 1 DESC LIMIT 2)
)"""
_SIZES = """
sizes AS (SELECT array_to_string(p[1:i], '/') AS prefix, sum(coalesce(size, 0))::BIGINT AS size, count(*) AS file_count
  FROM (SELECT string_split(rel_path, '/') AS p, size FROM remote_files), LATERAL (SELECT unnest(range(0, len(p) + 1)) AS i) GROUP BY 1)"""
_POLICY = {"last": 3, "daily": 5, "monthly": 4, "yearly": 2}
_IGNORE = ["# generated", "*/de/", "!de/d[13]*.md", "/src1/**/d?.md", "d*[!0-6].md", "en/d1[0-4]?.md"]
_ROUTES = [("ops", ["click", "purchase"], ["dir[0-3]/*", "dir6/f?.md"]), ("all", ["view", "click", "purchase", "signup", "logout"], []), ("one", ["view"], ["dir5/f1.md", "nowhere"]), ("none", ["view"], ["*.txt"])]


def _states(spark, sf):
    return status.three_way_status(t.local_files(spark, sf), t.remote_files(spark, sf), t.manifest(spark, sf))


def _targets(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.date_format(F.expr("o_orderdate - interval 12 hours"), "yyyy-MM-dd").alias("target")).distinct()


QUERIES = {
    "j01_three_way_status": lambda s, d: _states(s, d).select("rel_path", "status"),
    "a09_status_counts": lambda s, d: status.status_counts(_states(s, d)),
    "a10_push_plan": lambda s, d: status.push_plan(_states(s, d)),
    "a11_pull_plan": lambda s, d: status.pull_plan(_states(s, d)),
    "j27_delete_plan": lambda s, d: status.delete_plan(t.manifest(s, d).where("rel_path is not null"), t.remote_files(s, d), t.local_files(s, d)),
    "j02_mirror_audit": lambda s, d: mirrors.audit(t.manifest(s, d), t.manifest_remotes(s, d), t.BACKENDS),
    "j08_unseeded": lambda s, d: mirrors.unseeded(t.manifest(s, d), t.manifest_remotes(s, d), "sftp"),
    "j15_status_by_backend": lambda s, d: mirrors.by_backend(t.manifest(s, d), t.manifest_remotes(s, d), t.BACKENDS),
    "j24_retry_plan": lambda s, d: mirrors.retry_plan(t.manifest_remotes(s, d)),
    "a13_backend_status": lambda s, d: mirrors.backend_status(t.manifest_remotes(s, d)),
    "a14_quarantine": lambda s, d: mirrors.quarantine(t.manifest_remotes(s, d)),
    "j03_orphan_blobs": lambda s, d: snapshots.orphans(*t.blobs(s, d)),
    "j05_restore_plan": lambda s, d: snapshots.restore_plan(t.manifest(s, d).where("rel_path is not null").select(F.col("rel_path").alias("path"), F.col("synced_hash").alias("hash")), t.blobs(s, d)[1]),
    "j11_snapshot_diff": lambda s, d: snapshots.diff(t.snapshot_files(s, d), "1995-03", "1995-04"),
    "j13_as_of": lambda s, d: snapshots.as_of(t.snapshots(s, d), _targets(s, d)),
    "w01_version_labels": lambda s, d: snapshots.versions(t.snapshot_files(s, d), dealt=True),
    "w03_retention_keep": lambda s, d: snapshots.keep_set(t.snapshots(s, d), **_POLICY),
    "w04_prune": lambda s, d: snapshots.prune(t.snapshots(s, d), **_POLICY),
    "a22_history_counts": lambda s, d: snapshots.history_counts(t.snapshot_files(s, d)),
    "a01_stats_by_user": lambda s, d: log.stats(t.sync_events(s, d), "user", 20),
    "a01_stats_by_backend": lambda s, d: log.stats(t.sync_events(s, d), "backend", backend="drive"),
    "a01_stats_by_machine": lambda s, d: log.stats(t.sync_events(s, d), "machine"),
    "a01_stats_totals": lambda s, d: log.totals(log.stats(t.sync_events(s, d), "user")),
    "a01_stats_by_action": lambda s, d: log.stats(t.sync_events(s, d), "action"),
    "a02_stats_by_day": lambda s, d: log.stats(t.sync_events(s, d), "day"),
    "p14_window_stats": lambda s, d: log.stats(log.between(t.sync_events(s, d), "2024-01-05 00:00:00", "2024-01-12 12:00:00"), "machine"),
    "a05_presence": lambda s, d: log.presence(t.sync_events(s, d)),
    "w10_cursor": lambda s, d: log.after_cursor(t.sync_events(s, d), user="u7", action="click").select("ord", "user", "action"),
    "n02_capped_files": lambda s, d: t.many_files(s, d).select("ord", F.md5(F.array_join(json_files.capped_files(F.col("files")), "|")).alias("files"), F.array_join(F.transform(json_files.capped_resolved(F.col("resolved")), lambda x: x["path"]), "|").alias("resolved")),
    "j16_routes": lambda s, d: log.routed(t.sync_events(s, d), _ROUTES).select("ord", "route", F.array_join("files", "|").alias("files")),
    "a06_directory_sizes": lambda s, d: tree.rollup(t.remote_files(s, d)),
    "n01_largest_paths": lambda s, d: tree.largest(t.remote_files(s, d), 25),
    "n04_sibling_rank": lambda s, d: tree.sibling_rank(t.remote_files(s, d)),
    "n11_children": lambda s, d: tree.children(t.remote_files(s, d), ""),
    "j17_ignore_rules": lambda s, d: t.remote_files(s, d).where("rel_path is not null").select("rel_path", rules.ignored(F.col("rel_path"), _IGNORE).alias("ignored")),
    "p09_glob_filter": lambda s, d: t.remote_files(s, d).where(F.col("rel_path").rlike(rules.fnmatch_regex("*/[!d]?/d[1-3]*[^0].md"))).select("rel_path"),
    "f05_human_size": lambda s, d: t.remote_files(s, d).where("rel_path is not null").select("rel_path", text.human_size(F.col("size") * 1000).alias("size")),
    "f11_blob_shards": lambda s, d: t.blobs(s, d)[0].select(rules.shard(F.col("h")).alias("path")),
}


def _stats_sql(key: str, where: str = "true", tail: str = "") -> str:
    return f"WITH {_LOG} SELECT {key} AS key, count(*) AS events, sum(len(files))::BIGINT AS files, sum(conflicts)::BIGINT AS conflicts FROM log WHERE {where} GROUP BY 1 {tail}"


ORACLE_SQL = {
    "j01_three_way_status": f"WITH {_FILES} SELECT rel_path, status FROM states",
    "a09_status_counts": f"WITH {_FILES} SELECT status, count(*) AS files FROM states GROUP BY 1",
    "a10_push_plan": f"""WITH {_FILES} SELECT CASE status WHEN 'conflict' THEN 'conflict' WHEN 'deleted_local' THEN 'delete' ELSE 'upload' END AS bucket, count(*) AS files,
        sum(coalesce(local_size, 0))::BIGINT AS bytes FROM states WHERE status IN ('local_ahead', 'new_local', 'conflict', 'deleted_local') GROUP BY 1""",
    "a11_pull_plan": f"""WITH {_FILES} SELECT CASE status WHEN 'conflict' THEN 'conflict' ELSE 'download' END AS bucket, count(*) AS files,
        sum(coalesce(remote_size, 0))::BIGINT AS bytes FROM states WHERE status IN ('remote_ahead', 'new_remote', 'conflict') GROUP BY 1""",
    "j27_delete_plan": f"""WITH {_FILES} SELECT rel_path, CASE WHEN r.rel_path IS NOT NULL AND l.rel_path IS NOT NULL THEN 'both' WHEN r.rel_path IS NOT NULL THEN 'remote_only'
        WHEN l.rel_path IS NOT NULL THEN 'local_only' ELSE 'absent' END AS bucket FROM manifest LEFT JOIN remote_files r USING (rel_path) LEFT JOIN local_files l USING (rel_path)""",
    "j02_mirror_audit": f"""WITH {_FILES} SELECT backend, count(*) AS checked, count(*) FILTER (bad) AS drift, count(*) FILTER (NOT bad) AS verified FROM (
        SELECT b.backend, coalesce(state = 'ok' AND remote_hash IS DISTINCT FROM synced_hash, false) AS bad FROM manifest m CROSS JOIN (VALUES ('drive'), ('dropbox'), ('sftp')) b(backend)
        LEFT JOIN remotes r ON r.rel_path = m.rel_path AND r.backend = b.backend) GROUP BY 1""",
    "j08_unseeded": f"WITH {_FILES} SELECT rel_path FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM remotes r WHERE r.rel_path = m.rel_path AND backend = 'sftp')",
    "j15_status_by_backend": f"""WITH {_FILES}, cells AS (SELECT rel_path, backend, CASE state WHEN 'pending_retry' THEN 'pending' WHEN 'failed_perm' THEN 'failed' ELSE state END AS cell FROM remotes)
        SELECT rel_path, coalesce(a.cell, 'unseeded') AS drive, coalesce(b.cell, 'unseeded') AS dropbox, coalesce(c.cell, 'unseeded') AS sftp FROM manifest m
        LEFT JOIN cells a ON a.rel_path = m.rel_path AND a.backend = 'drive' LEFT JOIN cells b ON b.rel_path = m.rel_path AND b.backend = 'dropbox'
        LEFT JOIN cells c ON c.rel_path = m.rel_path AND c.backend = 'sftp'""".replace("SELECT rel_path, coalesce(a", "SELECT m.rel_path, coalesce(a"),
    "j24_retry_plan": f"WITH {_FILES} SELECT rel_path, string_agg(backend, ',' ORDER BY backend) AS backends FROM remotes WHERE state = 'pending_retry' AND rel_path IS NOT NULL GROUP BY 1",
    "a13_backend_status": f"""WITH {_FILES} SELECT backend, CASE WHEN count(*) FILTER (state = 'failed_perm') > 0 THEN 'failed' WHEN count(*) FILTER (state = 'pending_retry') > 0 THEN 'pending' ELSE 'ok' END AS status,
        count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'pending_retry') AS pending, count(*) FILTER (state = 'failed_perm') AS failed,
        arg_max(last_error, ord) FILTER (last_error <> '') AS last_error FROM remotes GROUP BY 1""",
    "a14_quarantine": f"WITH {_FILES} SELECT backend, count(*) AS files, min(rel_path) AS first_path FROM remotes WHERE state = 'failed_perm' GROUP BY 1",
    "j03_orphan_blobs": f"WITH {_FILES} SELECT DISTINCT h FROM base WHERE h NOT IN (SELECT h FROM base WHERE doc_id % 3 <> 0 AND h IS NOT NULL)",
    "j05_restore_plan": f"""WITH {_FILES} SELECT rel_path AS path, CASE WHEN synced_hash IS NOT NULL AND synced_hash NOT IN (SELECT h FROM base WHERE doc_id % 3 <> 0 AND h IS NOT NULL) THEN 'missing-blob' ELSE 'restore' END AS action FROM manifest""",
    "j11_snapshot_diff": f"""WITH {_SNAPS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.hash IS NOT DISTINCT FROM b.hash THEN 'unchanged' ELSE 'modified' END AS change
        FROM (SELECT * FROM files WHERE timestamp = '1995-03') a FULL JOIN (SELECT * FROM files WHERE timestamp = '1995-04') b ON a.path = b.path""",
    "j13_as_of": f"""WITH {_SNAPS}, targets AS (SELECT DISTINCT strftime(o_orderdate - INTERVAL 12 HOURS, '%Y-%m-%d') AS target FROM orders)
        SELECT target, timestamp FROM targets ASOF LEFT JOIN snaps ON target >= timestamp""",
    "w01_version_labels": f"""WITH {_SNAPS}, firsts AS (SELECT path, hash, min(timestamp) AS first FROM files GROUP BY 1, 2), n AS (SELECT path, hash, row_number() OVER (PARTITION BY path ORDER BY first, hash) AS v FROM firsts)
        SELECT path, timestamp, 'v' || v AS version FROM files JOIN n USING (path, hash)""",
    "w03_retention_keep": f"WITH {_SNAPS} SELECT timestamp FROM keep",
    "w04_prune": f"WITH {_SNAPS} SELECT timestamp FROM snaps WHERE tag IS NULL AND timestamp NOT IN (SELECT timestamp FROM keep)",
    "a22_history_counts": f"WITH {_SNAPS} SELECT path, count(DISTINCT hash) AS versions, count(*) AS appearances FROM files GROUP BY 1",
    "a01_stats_by_user": _stats_sql('"user"', tail="ORDER BY events DESC, key LIMIT 20"),
    "a01_stats_by_backend": _stats_sql("'drive'"),
    "a01_stats_by_machine": _stats_sql("machine"),
    "a01_stats_totals": f"WITH {_LOG} SELECT count(*) AS events, sum(len(files))::BIGINT AS files, sum(conflicts)::BIGINT AS conflicts FROM log",
    "a01_stats_by_action": _stats_sql("action"),
    "a02_stats_by_day": _stats_sql("strftime(ts, '%Y-%m-%d')"),
    "p14_window_stats": _stats_sql("machine", "ts BETWEEN '2024-01-05 00:00:00' AND '2024-01-12 12:00:00'"),
    "a05_presence": f"""WITH {_LOG}, head AS (SELECT *, row_number() OVER (PARTITION BY "user", machine ORDER BY ts DESC, ord) AS r FROM log),
        f AS (SELECT "user", machine, ts, ord, unnest(files) AS file, generate_subscripts(files, 1) AS pos FROM log),
        g AS (SELECT *, row_number() OVER (PARTITION BY "user", machine, file ORDER BY ts DESC, ord, pos) AS r FROM f),
        k AS (SELECT *, row_number() OVER (PARTITION BY "user", machine ORDER BY ts DESC, ord, pos) AS n FROM g WHERE r = 1),
        few AS (SELECT "user", machine, string_agg(file, '|' ORDER BY n) AS recent_files FROM k WHERE n <= 5 GROUP BY 1, 2)
        SELECT h."user", h.machine, action, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_seen, recent_files FROM head h LEFT JOIN few ON few."user" = h."user" AND few.machine = h.machine WHERE r = 1""",
    "w10_cursor": f"""WITH {_LOG} SELECT ord, "user", action FROM log WHERE ord > coalesce((SELECT min(ord) FROM log WHERE "user" = 'u7' AND action = 'click'), -1)""",
    "n02_capped_files": f"""WITH {_LOG} SELECT ord, md5(array_to_string(CASE WHEN n > 100 THEN list_append(f[1:100], '... and ' || (n - 100) || ' more') ELSE f END, '|')) AS files,
        array_to_string(CASE WHEN n > 100 THEN list_append(f[1:100], '... and ' || (n - 100) || ' more') ELSE f END, '|') AS resolved FROM (SELECT ord, 95 + ord % 20 AS n, list_transform(range(1, 96 + ord % 20), lambda i: 'f' || i) AS f FROM log)""",
    "j16_routes": f"""WITH {_LOG}, r AS (
        SELECT ord, 'ops' AS route, list_filter(files, lambda x: regexp_matches(x, '^dir[0-3]/|^dir6/f.\\.md$')) AS f FROM log WHERE action IN ('click', 'purchase')
        UNION ALL SELECT ord, 'all', files FROM log WHERE action IN ('view', 'click', 'purchase', 'signup', 'logout')
        UNION ALL SELECT ord, 'one', list_filter(files, lambda x: x = 'dir5/f1.md') FROM log WHERE action = 'view')
        SELECT ord, route, array_to_string(f, '|') AS files FROM r WHERE len(f) > 0""",
    "a06_directory_sizes": f"WITH {_FILES}, {_SIZES} SELECT prefix, size, file_count FROM sizes",
    "n01_largest_paths": f"WITH {_FILES}, {_SIZES} SELECT prefix, size FROM sizes WHERE prefix <> '' ORDER BY size DESC, prefix LIMIT 25",
    "n04_sibling_rank": f"WITH {_FILES}, {_SIZES} SELECT prefix, row_number() OVER (PARTITION BY regexp_replace(prefix, '/?[^/]*$', '') ORDER BY size DESC, prefix) AS rank FROM sizes WHERE prefix <> ''",
    "n11_children": f"WITH {_FILES} SELECT DISTINCT split_part(rel_path, '/', 1) AS name FROM remote_files",
    "j17_ignore_rules": f"""WITH {_FILES} SELECT rel_path, CASE WHEN regexp_matches(rel_path, '/en/d1[0-4][^/]\\.md$') THEN true WHEN regexp_matches(rel_path, '/d[^/]*[^0-6/]\\.md$') THEN true WHEN regexp_matches(rel_path, '^src1/.*d[^/]\\.md$') THEN true
        WHEN regexp_matches(rel_path, '/de/d[13][^/]*\\.md$') THEN false WHEN regexp_matches(rel_path, '^[^/]*/de/') THEN true ELSE false END AS ignored FROM remote_files""",
    "p09_glob_filter": f"WITH {_FILES} SELECT rel_path FROM remote_files WHERE regexp_matches(rel_path, '/[^d]./d[1-3].*[\\^0]\\.md$')",
    "f05_human_size": f"""WITH {_FILES} SELECT rel_path, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size
        FROM (SELECT rel_path, size * 1000 AS n FROM remote_files)""",
    "f11_blob_shards": f"WITH {_FILES} SELECT DISTINCT h[1:2] || '/' || h AS path FROM base WHERE h IS NOT NULL",
}
