"""What is written and read again: versions, published events, polled logs, intervals of history, migration."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from driftwell.operators import intervals, migrate, snapshots
from driftwell.plans import catalog, durable, state_ops
from driftwell.sources import tables
from driftwell.sources.commits import Folder, Version, VersionedTable
from driftwell.streaming import polling, publish

ROW = "k string, v bigint, tags map<string,string>"


def table(spark, tmp_path, shards=8):
    return VersionedTable(spark, f"file://{tmp_path}/table", ROW, "k", shards)


def rows(spark, *pairs):
    return spark.createDataFrame([(k, v, {"a": str(v)}) for k, v in pairs], ROW)


def content(df):
    return {r.k: r.v for r in df.collect()}


# ---- versions


def test_versions_merge_and_stay(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.version() == Version()
    t.merge(rows(spark, ("a", 1), ("b", 2), (None, 3)))
    first = t.version()
    t.merge(rows(spark, ("a", 5), ("c", 6)), spark.createDataFrame([("b",), ("gone",)], "k string"))
    assert content(t.read()) == {"a": 5, "c": 6} and content(t.read(first)) == {"a": 1, "b": 2}
    t.merge(rows(spark).limit(0), spark.createDataFrame([("a",), ("c",)], "k string"))
    assert t.version().number == 3 and t.read().count() == 0
    assert t.merge(rows(spark)).number == 3  # nothing to do, no version
    with pytest.raises(Exception, match="twice in one write"):
        t.merge(rows(spark, ("x", 1), ("x", 2)))
    assert t.version().number == 3


def test_two_writers_at_once_lose_no_row(spark, tmp_path, monkeypatch):
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    one.merge(rows(spark, *[(f"k{i}", 0) for i in range(20)]))
    stage, meanwhile = VersionedTable._stage, []

    def slow(self, df):
        out = stage(self, df)
        if self is one and len(meanwhile) < 2:  # the other writer publishes between this one's staging and publishing, twice
            meanwhile.append(1)
            two.merge(rows(spark, (f"k{len(meanwhile)}", 7), (f"n{len(meanwhile)}", 8)))
        return out

    monkeypatch.setattr(VersionedTable, "_stage", slow)
    one.merge(rows(spark, ("k1", 1), ("k3", 3)), spark.createDataFrame([("k9",)], "k string"))
    want = {f"k{i}": 0 for i in range(20)} | {"k1": 1, "k3": 3, "n1": 8} | ({"k2": 7, "n2": 8} if len(meanwhile) == 2 else {})
    del want["k9"]
    assert content(one.read()) == want and len(meanwhile) >= 1


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.merge(rows(spark, ("a", 1)))
    create = Folder.create
    monkeypatch.setattr(Folder, "create", lambda self, name, text: 1 // 0)
    with pytest.raises(ZeroDivisionError):
        t.merge(rows(spark, ("a", 2)))
    monkeypatch.setattr(Folder, "create", create)
    assert content(t.read()) == {"a": 1} and len(os.listdir(tmp_path / "table/data")) == 2
    assert t.vacuum(hours=1) == 0 and t.vacuum(hours=0) == 1 and content(t.read()) == {"a": 1}
    for i in range(4):
        t.merge(rows(spark, ("a", i)))
    assert t.vacuum(keep=2, hours=0) == 3 and t.numbers() == [4, 5] and content(t.read()) == {"a": 3}


def test_a_transaction_counts_once(spark, tmp_path):
    t = table(spark, tmp_path)
    for n, v in ((0, 1), (0, 9), (1, 2), (0, 9), (1, 9)):
        t.merge(rows(spark, ("a", v)), transaction=("job", n))
    assert content(t.read()) == {"a": 2} and t.version().number == 2 and t.version().transactions == {"job": 1}


def test_adding_reads_keys_and_keeps_bodies(spark, tmp_path):
    t = table(spark, tmp_path, 2)
    t.add(rows(spark, ("a", 1), ("a", 1), ("b", 2), (None, 1)))
    folders = sum(len(f) for f in t.version().shards.values())
    assert t.add(rows(spark, ("a", 5), ("b", 6))).number == 1 and content(t.read()) == {"a": 1, "b": 2}
    t.add(rows(spark, *[(f"n{i}", i) for i in range(9)]))
    assert t.read().count() == 11 and sum(len(f) for f in t.version().shards.values()) > folders


def test_small_files_are_made_once(spark, tmp_path):
    f = Folder(spark, f"file://{tmp_path}/x")
    assert f.names() == [] and f.create("a", "hé\n") and not f.create("a", "other") and f.read("a") == "hé\n" and f.names() == ["a"]


# ---- publishing

ROUTES = [("ops", ["push"], ["src/*"]), ("all", [], [])]


def sent(spark, *numbers, first=0):
    out = [(first + i, f"u{i % 2}", f"m{i % 3}", "push" if i % 2 else "pull", f"2026-05-0{1 + i % 3} 00:00:{i:02d}", [f"src/f{i}", "top"] if i % 4 else [], "p") for i in numbers]
    return spark.createDataFrame(out, publish.EVENT.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def published(spark, root):
    ledger = publish.Ledger(spark, root)
    log_ = sorted(r.ord for r in ledger.read("log").collect())
    return log_, sorted(r.message for r in ledger.read("inbox").collect()), sorted((r.ord, r.route, *r.files) for r in ledger.read("deliveries").collect())


def expected(numbers, own=None):
    out = [i for i in numbers]
    inbox = sorted(f"u{i % 2}@m{i % 3} {'push' if i % 2 else 'pull'}ed [{f'src/f{i}, top' if i % 4 else 'no files'}] in 'p' at 2026-05-0{1 + i % 3}T00:00:{i:02d}" for i in numbers if f"m{i % 3}" != own)
    sent_ = sorted([(i, "ops", f"src/f{i}") for i in numbers if i % 2 and i % 4] + [(i, "all", *([f"src/f{i}"] if i % 4 else [])) for i in numbers])
    sent_ = [(i, r, *([f"src/f{i}", "top"][: len(f)] if f else [])) for i, r, *f in sent_]
    return sorted(out), inbox, sent_


def stream(spark, folder, handle, checkpoint):
    source = spark.readStream.schema(publish.EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    query = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


@pytest.mark.parametrize("dies_after", ["log", "inbox", "deliveries", "mark"])
def test_each_event_once_though_the_sink_dies_between_writes(spark, tmp_path, monkeypatch, dies_after):
    for part in (sent(spark, *range(4)), sent(spark, *range(3, 8)), sent(spark, 0, 9, first=100).where("ord in (100, 109)")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    root, deaths = f"file://{tmp_path}/out", []
    ledger = publish.Ledger
    folder, mark = ledger.folder, ledger.mark

    def dying_folder(self, target, app, batch, kind="batch"):
        order = ["log", "inbox", "deliveries"]
        if batch == 1 and not deaths and dies_after in order and order.index(dies_after) < 2 and target == order[order.index(dies_after) + 1]:
            return folder(self, target, app, batch, kind) + ":/not a folder\0"
        return folder(self, target, app, batch, kind)

    def dying_mark(self, app, batch):
        if batch == 1 and not deaths and dies_after == "deliveries":
            raise RuntimeError("killed before the mark")
        out = mark(self, app, batch)
        if batch == 1 and not deaths and dies_after == "mark":
            raise RuntimeError("killed after the mark")
        return out

    monkeypatch.setattr(ledger, "folder", dying_folder)
    monkeypatch.setattr(ledger, "mark", dying_mark)
    handle = publish.publisher(root, "app", ROUTES)
    with pytest.raises(Exception):
        stream(spark, f"{tmp_path}/in", handle, f"{tmp_path}/ck")
    if dies_after != "mark":
        assert len(publish.Ledger(spark, root).read("log").collect()) == 4  # nothing of the batch that died is seen
    deaths.append(1)
    stream(spark, f"{tmp_path}/in", handle, f"{tmp_path}/ck")
    numbers = [*range(8), 109]
    log_, inbox, sent_ = published(spark, root)
    assert log_ == numbers and len(inbox) == 9
    assert [s for s in sent_ if s[0] < 100] == expected(range(8))[2] and inbox[:] == sorted(expected([*range(8), 9])[1])


def test_batches_that_come_again_and_compaction(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    handle = publish.publisher(root, "app", ROUTES, machine="m1")
    batches = [sent(spark, *range(4)), sent(spark, *range(2, 6)), sent(spark, 6), sent(spark).limit(0)]
    for n, b in enumerate(batches):
        handle(b, n)
    want = expected(range(7), own="m1")
    assert published(spark, root) == want
    handle(sent(spark, 8), 1)  # a batch number that is there already: nothing
    publish.publisher(root, "other", ROUTES)(sent(spark, 1, 3), 0)  # events that another application has published
    assert published(spark, root) == want
    ledger = publish.Ledger(spark, root)
    assert ledger.compact("app") == 4 and published(spark, root) == want and len(ledger.folders("log")) == 2
    ledger.sweep("app")
    assert published(spark, root) == want and ledger.compact("app") == 0
    handle(sent(spark, 8), 3)
    handle(sent(spark, 9), 4)
    assert published(spark, root)[0] == [*range(7), 9] and ledger.compact("app") == 2
    ledger.sweep("app")
    assert published(spark, root)[0] == [*range(7), 9]
    with pytest.raises(ValueError):
        publish.publisher(root, "two words", [])


def test_publishing_odd_events(spark, tmp_path):
    odd = [(None, None, None, None, None, None, None), (1, "u", "m", "push", None, [f"f{i}" for i in range(104)], "p"), (2, "u", "m", "push", None, [f"f{i}" for i in range(104)], "p")]
    publish.publisher(f"file://{tmp_path}/out", "a", ROUTES)(spark.createDataFrame(odd, publish.EVENT), 0)
    got = publish.Ledger(spark, f"file://{tmp_path}/out").read("log").collect()
    assert sorted((r.ord or 0, len(r.files)) for r in got) == [(0, 0), (1, 101)]


# ---- polling


def put_log(folder, name, numbers, **more):
    os.makedirs(folder, exist_ok=True)
    cells = [{"user": "u", "machine": f"m{i % 2}", "timestamp": f"2026-01-01T00:00:{i:02d}", "files": [f"f{i}"], "action": "push", **more} for i in numbers]
    with open(f"{folder}/{name}.tmp", "w") as f:
        json.dump({"events": cells}, f)
    os.replace(f"{folder}/{name}.tmp", f"{folder}/{name}")


def poll(spark, tmp_path, **options):
    spark.dataSource.register(polling.LogSource)
    before = spark.read.parquet(f"{tmp_path}/out").count() if os.path.exists(f"{tmp_path}/out") else 0
    source = spark.readStream.format("driftwell_log").options(**options).load(f"{tmp_path}/logs/*.json")
    source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(polling.SCHEMA).parquet(f"{tmp_path}/out") if os.path.exists(f"{tmp_path}/out") else None
    all_ = sorted((os.path.basename(r.log)[:-5], int(r.files[0][1:])) for r in got.collect())
    return all_, len(all_) - before


def test_polling_restarts_from_its_keys(spark, tmp_path):
    logs = tmp_path / "logs"
    put_log(logs, "a.json", range(3))
    put_log(logs, "b.json", [])
    assert poll(spark, tmp_path) == ([], 0)  # nothing old is shown
    put_log(logs, "a.json", range(5))
    put_log(logs, "b.json", range(2))  # was empty: all of it is new
    assert poll(spark, tmp_path) == ([("a", 3), ("a", 4), ("b", 0), ("b", 1)], 4)
    assert poll(spark, tmp_path)[1] == 0
    put_log(logs, "a.json", range(8, 10))  # cut: its last key is gone, so all of it comes
    put_log(logs, "c.json", range(1))  # a new log
    assert poll(spark, tmp_path)[0][2:] == [("a", 8), ("a", 9), ("b", 0), ("b", 1), ("c", 0)]
    (logs / "a.json").write_text("{half a fi")
    put_log(logs, "b.json", range(3))
    assert poll(spark, tmp_path)[1] == 1  # one log cannot be read: the others go on
    put_log(logs, "a.json", range(8, 12))
    got, new = poll(spark, tmp_path)
    assert {x for x in got if x[0] == "a"} == {("a", i) for i in (3, 4, 8, 9, 10, 11)} and new >= 2


def test_polling_leaves_out_a_machine_and_reads_old_events(spark, tmp_path):
    put_log(tmp_path / "logs", "a.json", range(4))
    assert poll(spark, tmp_path, startingOffsets="earliest", machine="m1") == ([("a", 0), ("a", 2)], 2)


def test_keys_bound_what_is_read(tmp_path):
    put_log(tmp_path, "a", [0, 1, 2, 1, 3])
    events = json.loads((tmp_path / "a").read_text())["events"]
    key = [polling.key_of(e) for e in events]
    places = lambda after, until: [i for i, _ in polling.between(events, after, until)]
    assert places(key[0], key[2]) == [1, 2] and places(key[1], key[4]) == [2, 3, 4] and places("gone", key[2]) == [0, 1, 2] and places(None, "later") == [0, 1, 2, 3, 4]
    reader = polling._Reader({"path": f"{tmp_path}/a", "startingOffsets": "earliest"})
    seen = reader.latestOffset()
    (tmp_path / "a").write_text("{")
    assert reader.initialOffset() == {} and reader.latestOffset() == seen and reader.partitions(seen, seen) == []


# ---- history as intervals


def test_intervals_are_the_history(spark):
    r, stamps = random.Random(3), [f"2026-01-{d:02d}" for d in range(1, 15)]
    files = [(s, f"p{p}", r.choice("ab") if r.random() < 0.8 else None) for s in stamps for p in range(12) if r.random() < 0.8]
    files += [(s, None, "x") for s in stamps] + [(s, "stays", "same") for s in stamps]
    df = spark.createDataFrame(files, "timestamp string, path string, hash string")
    numbers = intervals.numbered(df)
    history = intervals.intervals(df, numbers)
    assert [tuple(x) for x in history.where("path = 'stays'").collect()] == [("stays", "same", 1, 14)]
    named = df.where("path is not null")
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert same(intervals.expanded(history, numbers), named)
    assert same(intervals.versions(history, numbers), snapshots.versions(df).select("path", "timestamp", "version"))
    assert same(intervals.counts(history), snapshots.history_counts(df).select("path", "versions", "appearances"))
    for target in ("2025", "2026-01-03", "2026-01-03x", "2027"):
        assert same(intervals.as_of(history, numbers, target), snapshots.as_of_view(named, named.select("timestamp"), target))
    marks = snapshots.transitions(snapshots.versions(df)).where("changed").join(numbers, "timestamp").select("path", "n", "version")
    assert same(intervals.transitions(history).where("changed").select("path", "last", "version"), marks)
    grown = intervals.intervals(df.where("timestamp < '2026-01-05'"), numbers)
    for n in range(5, 15):
        grown = intervals.extended(grown, df.where(F.col("timestamp") == stamps[n - 1]).select("path", "hash"), n)
        grown = spark.createDataFrame(grown.collect(), intervals.INTERVAL)
    assert same(grown.select("path", "hash", "first", "last"), history)


def test_intervals_of_changes_need_no_files(spark):
    r, stamps = random.Random(4), [f"2026-01-{d:02d}" for d in range(1, 15)]
    changes = [(s, f"p{p}", r.choice(["a", "b", None])) for s in stamps for p in range(12) if r.random() < 0.3] + [(stamps[0], None, "x"), (stamps[-1], "late", "a")]
    state, files = {}, []
    for s in stamps:
        state |= {path: h for t, path, h in changes if t == s and path}
        files += [(s, path, h) for path, h in state.items()]
    schema = "timestamp string, path string, hash string"
    numbers = intervals.numbered(spark.createDataFrame([(s, "p", "h") for s in stamps], schema))
    want = intervals.intervals(spark.createDataFrame(files, schema), numbers)
    got = intervals.of_changes(spark.createDataFrame(changes, schema), numbers)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(got) == key(want) and got.columns == want.columns
    for dealt in (False, True):
        assert key(intervals.transitions(got, dealt)) == key(intervals.transitions(want)) and key(intervals.versions(got, numbers, dealt)) == key(snapshots.versions(spark.createDataFrame(files, schema)).select("path", "timestamp", "version"))


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(path" in line]


@pytest.mark.parametrize("name", ["w01_intervals", "a22_interval_counts", "w01_interval_versions", "w02_interval_transitions", "w02_transitions", "w01_version_labels"])
def test_a_task_has_a_bounded_number_of_changes(spark, sf_dir, monkeypatch, name):
    """Tasks go by rows, not by compressed bytes; a path's windows share one exchange, and no file of each snapshot is made on the way."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 500)
    want = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500)
    [line] = exchanges((catalog.QUERIES | state_ops.QUERIES | durable.QUERIES)[name](spark, sf_dir))
    assert want > 4 and f", {want}), REPARTITION_BY_NUM" in line


# ---- migration


def test_snapshots_there_and_back(spark, tmp_path):
    root = f"file://{tmp_path}"
    blobs, lists, full = migrate.blob_store(spark, root, 4), migrate.blob_lists(spark, root, 4), migrate.full_copies(spark, root, 4)
    files = [("t1", "a", b"1"), ("t1", "b", b"1"), ("t1", "c/d", b"\x00\xff"), ("t2", "a", b"2"), ("t2", "b", b"1"), ("t2", "empty", b""), ("t3", None, b"x"), ("t3", "n", None)]
    copies = spark.createDataFrame(files, "timestamp string, path string, content binary")
    migrate.to_blobs(copies.where("timestamp = 't1'"), blobs, lists)
    assert blobs.read().count() == 2
    migrate.to_blobs(copies, blobs, lists)
    before = blobs.version(), lists.version()
    assert migrate.to_blobs(copies, blobs, lists) == before and blobs.read().count() == 4
    migrate.to_full(lists.read().where("timestamp = 't2'"), blobs.read(), full)
    migrate.to_full(lists.read(), blobs.read(), full)
    assert {(r.timestamp, r.path, bytes(r.content)) for r in full.read().collect()} == {f for f in files if None not in f} and full.version().number == 2
    assert migrate.to_full(lists.read(), blobs.read(), full).number == 2
    migrate.forget(["t2"], lists)
    assert {r.timestamp for r in lists.read().collect()} == {"t1"} and blobs.read().count() == 4
    lost = blobs.read().where(F.col("content") != b"1")
    with pytest.raises(Exception, match="no intact body"):
        migrate.to_full(lists.read(), lost, migrate.full_copies(spark, f"{root}/new"))


def test_bodies_are_shuffled_no_more_than_needed(spark, tmp_path, monkeypatch):
    """Copies are dealt by their hash once and by shard once; a migration that finds everything there touches no body."""
    root, plans = f"file://{tmp_path}", []
    blobs, lists, full = migrate.blob_store(spark, root, 4), migrate.blob_lists(spark, root, 4), migrate.full_copies(spark, root, 4)
    stage = VersionedTable._stage
    monkeypatch.setattr(VersionedTable, "_stage", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stage(self, df))
    monkeypatch.setattr(VersionedTable, "_touched", lambda self, df: {str(i) for i in range(4)})
    copies = spark.createDataFrame([(f"t{i % 2}", f"p{i}", b"%d" % (i % 3)) for i in range(8)] + [("t0", "p0", b"0")], "timestamp string, path string, content binary")
    migrate.to_blobs(copies, blobs, lists)
    migrate.to_full(lists.read(), blobs.read(), full)
    assert full.read().count() == 8 and blobs.read().count() == 3
    first = plans[-1]
    assert "Aggregate [entry" not in first.split("Join LeftOuter")[0] and "LeftAnti" not in first
    migrate.to_blobs(copies, blobs, lists)
    migrate.to_full(lists.read(), blobs.read(), full)
    assert all("content" not in p or "LocalRelation <empty>" in p for p in (plans[-3], plans[-1]))
    assert full.version().number == blobs.version().number == lists.version().number == 1


@pytest.mark.parametrize("count", [None, 20, 100_000_000_000])
def test_the_filter_never_calls_a_stored_hash_new(spark, count):
    hashes = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    stored = spark.createDataFrame(hashes.limit(1500).collect(), "h string")
    new, perhaps = migrate.split_by_bloom(hashes, stored, count)
    known = {r.h for r in stored.collect()}
    n, p = {r.h for r in new.collect()}, {r.h for r in perhaps.collect()}
    assert n | p == {r.h for r in hashes.collect()} and not n & known and not n & p
    assert count is not None or len(p) < 1500 + 100
    assert migrate.split_by_bloom(hashes, stored.limit(0))[1].count() == 0
