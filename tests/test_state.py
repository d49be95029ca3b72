"""Stored files, scans, streams, and rules of state operators that SQL over the test tables does not reach."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from driftwell.operators import checks, log, manifest, snapshots, tree
from driftwell.sources import json_files, scan, tables
from driftwell.streaming import feed


def write(folder, files):
    for name, body in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(body if isinstance(body, bytes) else body.encode())


def test_manifest_files_of_all_formats(spark, tmp_path):
    one = {"a.md": {"synced_hash": "h1", "drive_file_id": "d1"}, "/bad": {"synced_hash": "x"}, "b.md": {"synced_hash": "h2", "remote_file_id": "", "drive_file_id": "d2", "synced_remote_hash": ""}}
    two = {"c.md": {"synced_hash": "h3", "remote_file_id": "r3", "synced_at": "t", "synced_remote_hash": "e3", "remotes": {"sftp": {"state": "failed_perm", "attempts": 4}, "ftp": {}}, "extra": 1}}
    write(tmp_path, {"one.json": json.dumps(one), "two.json": json.dumps(two, indent=1), "three.json": "{damaged", "four.json": "[]"})
    texts = json_files.read_texts(spark, str(tmp_path))
    got = {r.rel_path: r for r in json_files.manifest(texts).collect()}
    assert set(got) == {"a.md", "b.md", "c.md"} and {os.path.basename(r.file) for r in json_files.unreadable(texts).collect()} == {"three.json", "four.json"}
    assert (got["a.md"].remote_file_id, got["a.md"].synced_remote_hash, got["a.md"].remotes) == ("d1", "h1", {})
    assert (got["b.md"].remote_file_id, got["b.md"].synced_remote_hash) == ("", "")
    assert got["c.md"].remotes["sftp"].attempts == 4 and got["c.md"].remotes["ftp"].state == "ok" and got["c.md"].synced_at == "t"
    assert {(r.rel_path, r.backend, r.state) for r in json_files.remotes(json_files.manifest(texts)).collect()} == {("c.md", "sftp", "failed_perm"), ("c.md", "ftp", "ok")}
    json_files.write_manifest(json_files.manifest(texts).drop("file"), f"{tmp_path}/out")
    again = json_files.manifest(spark.read.text(f"{tmp_path}/out").select(F.col("value").alias("text")))
    assert {r.rel_path: r.asDict(True) for r in again.collect()} == {k: {c: v for c, v in r.asDict(True).items() if c != "file"} for k, r in got.items()}


def test_logs_caches_inboxes_envelopes(spark):
    texts = lambda *rows: spark.createDataFrame([(r,) for r in rows], "text string")
    event = {"user": "u", "machine": "m", "timestamp": "t", "files": [f"f{i}" for i in range(103)], "action": "push", "project": "p", "new": 1}
    rows = json_files.sync_log(texts(json.dumps({"events": [event, {"user": "v", "machine": "m", "timestamp": "t2"}]}), "{")).orderBy("ord").collect()
    assert [r.ord for r in rows] == [0, 1] and rows[0].files[100:] == ["... and 3 more"] and rows[1].files == [] == rows[1].auto_resolved_files
    assert [r.user for r in json_files.events(texts(json.dumps(event), "x", '{"user": "a"}')).collect()] == ["u"]
    assert [tuple(r) for r in json_files.hash_cache(texts('{"a": [1, 2, "m"], "b": [1, 2], "c": [3, 4, "n", "s"]}')).orderBy("rel_path").collect()] == [("a", 1, 2, "m", ""), ("c", 3, 4, "n", "s")]
    line = json.dumps({"timestamp": "t", "title": "x", "message": "y", "user": "u"})
    assert json_files.inbox(texts(line, "", line)).count() == 2 and json_files.inbox(texts(line, "{bad")).count() == 0
    made = json_files.make_envelopes(spark.createDataFrame([("a\\b", "mine\n", "theirs\n", None, None, "drive")], "rel_path string, local_text string, remote_text string, base_text string, base_hash string, backend string"), "/p", "now")
    back = json_files.envelopes(json_files.inbox_lines(made).select(F.col("value").alias("text")).union(texts("[]", '{"version": 2}'))).collect()
    assert len(back) == 1 and back[0].path == "a/b" and back[0].local_hash == hashlib.sha256(b"mine\n").hexdigest() and "-theirs\n+mine\n" in back[0].unified_diff


def test_a_log_in_parts_is_one_log(spark, sf_dir):
    log = lambda *users: json.dumps({"events": [u and {"user": u, "machine": "m", "timestamp": "t"} for u in users]})
    parts = [("a", 2, log("a4")), ("a", 1, log("a1", None, "a3")), ("a", 0, "{"), ("a", None, log("a0")), ("b", 7, log("b0", "b1")), (None, 1, log("n1")), (None, 0, log("n0"))]
    rows = json_files.sync_log_parts(spark.createDataFrame(parts, "name string, part bigint, text string"), "name", "part")
    assert sorted((r.user, r.ord) for r in rows.collect()) == [("a0", 0), ("a1", 1), ("a3", 3), ("a4", 4), ("b0", 0), ("b1", 1), ("n0", 0), ("n1", 1)]
    stored = tables.log_texts(spark, sf_dir, span=100).select("machine", F.size(F.from_json("text", "events array<string>")["events"]).alias("n")).collect()
    assert max(r.n for r in stored) <= 100 and len(stored) > len({r.machine for r in stored})  # no whole log in one task


def test_snapshot_notes_that_cannot_be_read_stay(spark):
    notes = spark.createDataFrame([("t1", '{"tag": "", "total_files": 2}'), ("t2", "{"), ("t3", None)], "timestamp string, text string")
    got = {r.timestamp: (r.total_files, r.tag, r.action) for r in json_files.snapshot_catalogue(notes, notes.limit(0)).collect()}
    assert got == {"t1": (2, None, ""), "t2": (0, None, ""), "t3": (0, None, "")}


def test_scans(spark, tmp_path):
    write(tmp_path, {"a.md": "a", "_under/.hidden.md": "b", "x/y/z.md": "cc", "x/skip.txt": "d", "x/.driftignore": "", ".driftignore": "", "state.json": "{}"})
    os.symlink(f"{tmp_path}/x/y", f"{tmp_path}/link")
    files = scan.walk(spark, str(tmp_path), tasks=3)
    assert {r.rel_path: r.size for r in files.collect()} == {"a.md": 1, "_under/.hidden.md": 1, "x/y/z.md": 2, "link/z.md": 2, "x/skip.txt": 1, "x/.driftignore": 0, ".driftignore": 0, "state.json": 2}
    paths = lambda df: {r.rel_path for r in df.collect()}
    assert paths(scan.local_files(files, ["**/*.md", "*.md"])) == {"a.md", "_under/.hidden.md", "x/y/z.md", "link/z.md"}
    assert paths(scan.local_files(files, ["**/*"], ["link"], ["x/*.txt"], state=["state.json"])) == {"a.md", "_under/.hidden.md", "x/y/z.md", "x/.driftignore"}
    assert paths(scan.local_files(files, ["x/**"], rules_file=None)) == {"x/y/z.md", "x/skip.txt", "x/.driftignore"} and scan.local_files(files, []).count() == 0
    digests = {r.rel_path: (r.md5, r.sha256) for r in scan.with_digests(scan.local_files(files, ["*.md"]), str(tmp_path)).collect()}
    assert digests == {"a.md": (hashlib.md5(b"a").hexdigest(), hashlib.sha256(b"a").hexdigest())}
    assert scan.walk(spark, f"{tmp_path}/gone").count() == 0


def test_a_loop_of_links_ends(spark, tmp_path):
    write(tmp_path, {"a/x.md": "1", "b/y.md": "22", "top.md": ""})
    os.symlink(tmp_path, f"{tmp_path}/a/up")
    os.symlink(f"{tmp_path}/b", f"{tmp_path}/a/over")
    os.symlink(f"{tmp_path}/a", f"{tmp_path}/b/back")
    os.symlink(f"{tmp_path}/b", f"{tmp_path}/b/self")
    got = {r.rel_path for r in scan.walk(spark, str(tmp_path), tasks=2).collect()}
    assert got == {"a/x.md", "a/over/y.md", "b/y.md", "b/back/x.md", "top.md"}


def folded(rows):
    """The tries of each path and backend, one outcome after the other."""
    state, out = {}, []
    for path, backend, ord_, kind, hash_ in sorted(rows, key=lambda r: r[2]):
        tries, content = state.get((path, backend), (0, ""))
        tries = 0 if kind == "ok" else 1 if hash_ and hash_ != content else tries + 1
        state[path, backend] = (tries, hash_ or "")
        out.append((path, backend, ord_, "failed_perm" if kind == "pending_retry" and tries >= 10 else kind, tries))
    return sorted(out)


OUTCOMES = "rel_path string, backend string, ord bigint, state string, intended_hash string"


def outcomes():
    import random

    rng = random.Random(6)
    return [(f"f{rng.randrange(3)}", rng.choice(["a", "b"]), i, rng.choice(["pending_retry"] * 9 + ["ok", "failed_perm"]), rng.choice(["h1"] * 12 + ["h2", "", None])) for i in range(400)]


def test_tries_are_the_fold(spark):
    rows = outcomes()
    got = sorted(map(tuple, manifest.attempts(spark.createDataFrame(rows, OUTCOMES)).select("rel_path", "backend", "ord", "state", "attempts").collect()))
    assert got == folded(rows) and any(r[3] == "failed_perm" and r[4] >= 10 for r in got)


def test_tries_of_a_stream(spark, tmp_path):
    rows = outcomes()
    for k in range(4):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], OUTCOMES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(OUTCOMES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = feed.attempts(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("rel_path", "backend", "ord", "state", "attempts").collect())) == folded(rows)


def test_tries_of_a_stream_in_many_chunks(spark, tmp_path):
    import random

    rows = [("f", "a", i, "ok" if i % 37 == 0 else "pending_retry", f"h{i // 20 % 3}") for i in range(25_000)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, OUTCOMES).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(OUTCOMES).parquet(f"{tmp_path}/in")
    feed.attempts(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("rel_path", "backend", "ord", "state", "attempts").collect())) == folded(rows)


def test_tries_of_a_stream_out_of_order(spark, tmp_path):
    import datetime as dt
    import random

    rows, rng = outcomes(), random.Random(8)
    start = dt.datetime(2026, 1, 1)
    timed = [(*r, start + dt.timedelta(seconds=r[2])) for r in rows]
    late = sorted(timed, key=lambda r: r[2] + rng.randrange(120))  # up to two minutes late, across batches
    kinds = OUTCOMES + ", ts timestamp"
    for k in range(4):
        spark.createDataFrame(late[100 * k : 100 * k + 100], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    end = [("end", "a", 10**6, "ok", "h", start + dt.timedelta(days=1)), ("end", "a", 10**6 + 1, "ok", "h", start + dt.timedelta(days=2)), (*rows[0][:5], None)]
    spark.createDataFrame(end, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = feed.attempts_in_order(source, "3 minutes").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
    finally:
        spark.conf.unset(key)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("rel_path <> 'end'").select("rel_path", "backend", "ord", "state", "attempts").collect()))
    assert got == folded(rows)


EVENTS = "ord bigint, ts timestamp_ntz, user string, machine string, action string, files array<string>"


def events(spark, n, first=0):
    rows = [(i, f"2026-05-01 00:00:{i:02d}", f"u{i % 2}", f"m{i % 3}", "push", [f"f{i}"]) for i in range(first, n)]
    return spark.createDataFrame(rows, EVENTS.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_watching_once_a_run(spark, tmp_path):
    def run(log_, name="w"):
        seen = []
        feed.watch_once(log_, f"{tmp_path}/mark", name, "m0", lambda df: seen.extend(sorted(r.ord for r in df.collect())))
        return seen

    assert run(events(spark, 5)) == []  # the first run stores the end
    assert run(events(spark, 5)) == []
    assert run(events(spark, 9)) == [5, 7, 8]  # 6 is our own machine's
    assert run(events(spark, 12, 10)) == [10, 11]  # the log was cut: all of it comes again
    assert run(events(spark, 0 + 1).limit(0), "other") == [] and run(events(spark, 3), "other") == [1, 2]
    (mark,) = [p for p in (tmp_path / "mark").iterdir() if p.name.startswith(feed._slug("w"))]
    mark.write_text("{damaged")
    assert run(events(spark, 12)) == [] and run(events(spark, 12)) == []


def test_a_watcher_that_dies_sees_its_events_again(spark, tmp_path):
    run = lambda log_, handle: feed.watch_once(log_, f"{tmp_path}/mark", "w", "mine", handle)
    run(events(spark, 3), None)

    def dies(df):
        assert df.count() == 2
        raise RuntimeError("before the events are read")

    with pytest.raises(RuntimeError):
        run(events(spark, 5), dies)
    seen = []
    run(events(spark, 5), lambda df: seen.extend(r.ord for r in df.collect()))
    assert sorted(seen) == [3, 4]


def test_following_the_log_shows_each_event_once(spark, tmp_path):
    for part in (events(spark, 4), events(spark, 7, 2)):
        part.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(EVENTS.replace("timestamp_ntz", "timestamp")).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feed.follow(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(r.ord for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(7))


def test_inbox_is_taken(spark, tmp_path):
    box, lines = f"{tmp_path}/inbox", []
    put = lambda x: json_files.inbox_lines(spark.createDataFrame([("t", x, "y")], "timestamp string, title string, message string")).write.mode("append").text(box)
    take = lambda: feed.take_inbox(spark, box, lambda df: lines.append(sorted(r.title for r in json_files.inbox(df).collect())))
    take()
    assert lines == []
    put("a")
    take()
    take()
    assert lines == [["a"]]
    put("b")
    with pytest.raises(ZeroDivisionError):  # a taker that dies before it has read
        feed.take_inbox(spark, box, lambda df: 1 // 0)
    put("c")
    kept = []
    feed.take_inbox(spark, box, lambda df: (kept.append(df.count()), put("d"), take()))  # another take while the first one reads
    assert kept == [2] and lines[1:] == [["b", "c", "d"]]
    take()
    assert len(lines) == 2 and os.listdir(tmp_path) == []


def test_routes(spark):
    rows = [(1, "push", ["memory/a.md", "top.md"]), (2, "push", []), (3, "push", None), (4, "pull", ["memory/b.md"]), (5, "push", ["top.md"])]
    df = spark.createDataFrame(rows, "ord bigint, action string, files array<string>")
    got = {(r.ord, r.route): r.files for r in log.routed(df, [("usual", [], []), ("mem", ["push"], ["memory/*.md", "none"])]).collect()}
    assert got == {(1, "usual"): ["memory/a.md"], (1, "mem"): ["memory/a.md"], (2, "usual"): [], (2, "mem"): [], (3, "usual"): [], (3, "mem"): [], (4, "usual"): ["memory/b.md"]}
    assert log.routes_of(None, None) == [] and log.routes_of(None, "u")[0]["on"] == log.ROUTE_ACTIONS and log.routes_of([{"webhook_url": "a", "on": ["push"]}], "u") == [{"url": "a", "on": ["push"], "paths": ["**/*"]}]


def test_forget_takes_one_selector(spark):
    df = spark.createDataFrame([("2026-01-01T00-00-00Z", None), ("2026-01-02T00-00-00Z", "keep"), ("2026-01-03T00-00-00Z", ""), ("odd", None)], "timestamp string, tag string")
    gone = lambda **how: {r[0][:10] for r in snapshots.forget(df, **how).collect()}
    assert gone(timestamps=["2026-01-02T00-00-00Z"]) == {"2026-01-02"} and gone(before="2026-01-03") == {"2026-01-01", "odd"} and gone(keep_last=1) == {"2026-01-01", "2026-01-03"}
    assert gone(keep_days=1, now=F.lit("2026-01-03 12:00:00").cast("timestamp")) == {"2026-01-01", "odd"}
    for how in ({}, {"keep_last": 0}, {"keep_last": 2, "before": "2026"}, {"keep_last": -1}, {"timestamps": []}):
        with pytest.raises(ValueError):
            snapshots.forget(df, **how)


def test_orphans_fail_closed(spark):
    stored = spark.createDataFrame([("a",), ("b",), (None,)], "h string")
    lists = spark.createDataFrame([("t", "p", "a"), ("t", "q", None)], "timestamp string, path string, hash string")
    assert [r.h for r in snapshots.orphans(stored, snapshots.referenced(lists)).collect()] == ["b"] and snapshots.orphans(stored, snapshots.referenced(lists.limit(0))).count() == 0
    with pytest.raises(ValueError):
        snapshots.referenced(lists, stored.limit(1))


def test_listings(spark):
    df = spark.createDataFrame([("a/b.md", 3), ("a/B/c.md", 4), ("A.md", None), (None, 1)], "rel_path string, size bigint")
    asked = spark.createDataFrame([("",), ("a",), ("/a/b.md/",), ("a/B",), ("gone",), ("A.md",)], "path string")
    assert {r.path: (r.kind, r.size) for r in tree.stat(df, asked).collect()} == {"": ("dir", None), "a": ("dir", None), "/a/b.md/": ("file", 3), "a/B": ("dir", None), "gone": (None, None), "A.md": ("file", 0)}
    assert {r.name for r in tree.readdir(df, "a").collect()} == {".", "..", "b.md", "B"} and {r.name for r in tree.readdir(df, "").collect()} == {".", "..", "a", "A.md"}
    with pytest.raises(NotADirectoryError):
        tree.readdir(df, "A.md")
    with pytest.raises(FileNotFoundError):
        tree.readdir(df, "gone")
    with pytest.raises(Exception, match="more than 2 rows"):
        tree.guarded_listing(df, 2).collect()
    assert [(r.prefix, r["rank"]) for r in tree.tree_rank(df).orderBy("prefix").collect()] == [("A.md", 2), ("a", 1), ("a/B", 1), ("a/B/c.md", 1), ("a/b.md", 2)]
    raw = spark.createDataFrame([(b"0123456789",)], "x binary").select(tree.byte_range(F.col("x"), 3, 4), tree.byte_range(F.col("x"), -5, 2), tree.byte_range(F.col("x"), 2, -1), tree.byte_range(F.col("x"), 20, 3)).first()
    assert [bytes(x) for x in raw] == [b"3456", b"01", b"", b""]


def test_health_edges(spark):
    status = lambda *x: checks.health(spark.createDataFrame([(s,) for s in x], "status string")).first()[0]
    assert status("ok", "unsupported") == "ok" and status() == "ok" and status("warn", "fail", "ok") == "fail"
    df = events(spark, 3)
    age = lambda rows, now: checks.last_sync_age(rows, F.lit(now)).first().status
    assert age(df, "2026-05-02 00:00:02") == "ok" and age(df, "2026-05-02 00:00:03") == "warn" and age(df, "2026-05-04 00:00:03") == "fail" and age(df.limit(0), "2026-05-02") == "ok"
    assert age(df.withColumn("ts", F.lit(None).cast("timestamp_ntz")), "2026-05-02") == "warn"


def test_evicted_is_the_plain_loop(spark):
    import datetime as dt

    rows = [(f"b{i}", i * 37 % 11 + 1, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i * 29 % 97)) for i in range(60)]
    total, want = sum(r[1] for r in rows), set()
    for name, size, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if total <= 100:
            break
        want.add(name)
        total -= size
    df = spark.createDataFrame(rows, "name string, size bigint, atime timestamp")
    assert {r.name for r in snapshots.evicted(df, 100).collect()} == want and snapshots.evicted(df, 10**9).count() == 0


def test_diff_leaves_null_paths_out(spark):
    df = spark.createDataFrame([("1", None, "h"), ("2", None, "h"), ("1", "a", None), ("2", "a", None), ("2", "b", "x")], "timestamp string, path string, hash string")
    assert {(r.path, r.change) for r in snapshots.diff(df, "1", "latest").collect()} == {("a", "unchanged"), ("b", "added")}
