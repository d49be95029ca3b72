"""Every registered query against its SQL, and the rules that SQL over the test tables does not reach."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from driftwell.functions import rules
from driftwell.operators import log, snapshots, status, tree
from driftwell.plans import catalog, durable, listings, rules_text, state_ops


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as from read_parquet('{p}')")
    return con


ALL = {name: (query, part.ORACLE_SQL.get(name)) for part in (catalog, rules_text, state_ops, durable, listings) for name, query in part.QUERIES.items()}


@pytest.mark.parametrize("name", ALL)
def test_query_is_its_sql(spark, sf_dir, duck, name):
    query, sql = ALL[name]
    want = duck.execute(sql)
    cols = sorted(c[0] for c in want.description)
    got = query(spark, sf_dir)
    assert sorted(got.columns) == cols
    where = [[c[0] for c in want.description].index(c) for c in cols]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted((tuple(r[i] for i in where) for r in want.fetchall()), key=repr)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert {"status", "files"} == set(e.entry(spark).columns)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_status_table(spark):
    local = [("a", "x"), ("c", "x"), ("d", "y"), ("e", "y"), ("f", "x"), ("g", None), ("i", "x"), (None, "x")]
    remote = [("b", "x"), ("c", "x"), ("d", "z"), ("e", "x"), ("f", "z"), ("g", None), ("h", "x")]
    manifest = [("d", "x"), ("e", "x"), ("f", "x"), ("g", None), ("h", "x"), ("i", "x"), ("j", "x")]
    frame = lambda rows: spark.createDataFrame([(p, 1, h) for p, h in rows], "rel_path string, size bigint, hash string")
    m = spark.createDataFrame([(p, h, "") for p, h in manifest], "rel_path string, synced_hash string, synced_remote_hash string")
    got = {r.rel_path: r.status for r in status.three_way_status(frame(local), frame(remote), m).collect()}
    assert got == {
        "a": "new_local", "b": "new_remote", "c": "conflict", "d": "conflict", "e": "local_ahead", "f": "remote_ahead", "g": "in_sync",
        "h": "deleted_local", "i": "in_sync", "j": "deleted_local",
    }


def test_retention_days(spark):
    stamps = ["2026-05-05T08-00-00Z", "2026-05-05T10-00-00Z", "2026-05-05T12-00-00Z", "2026-05-04T09-00-00Z", "2026-05-04T14-00-00Z", "2026-05-03T10-00-00Z"]
    df = spark.createDataFrame([(x, None) for x in stamps], "timestamp string, tag string")
    assert {r[0] for r in snapshots.keep_set(df, daily=2).collect()} == {stamps[2], stamps[4]}
    assert snapshots.prune(df, daily=2).count() == 4 and snapshots.prune(df).count() == 0


def test_directory_sizes(spark):
    rows = [("src/x/deep/one.txt", 7), ("src/x/two.txt", 11), ("src/three.txt", 13), ("lone", 17), ("lone", 2), (None, 9), ("gap", None)]
    df = spark.createDataFrame(rows, "rel_path string, size bigint")
    got = {r.prefix: (r.size, r.file_count) for r in tree.rollup(df).collect()}
    assert got[""] == (50, 6) and got["src"] == (31, 3) and got["src/x"] == (18, 2) and got["src/x/deep"] == (7, 1) and got["lone"] == (19, 2) and got["gap"] == (0, 1)
    assert {r.name for r in tree.children(df, "src").collect()} == {"x", "three.txt"}
    counts = {r.prefix: (r.dirs, r.files, r.bytes) for r in tree.subtree_counts(df).collect()}
    assert counts[""] == (3, 5, 48) and counts["src"] == (2, 3, 31) and counts["src/x/deep"] == (0, 1, 7)


def test_version_labels_reuse_and_nulls(spark):
    df = spark.createDataFrame([("p", "1", "a"), ("p", "2", "b"), ("p", "3", "a"), ("p", "4", None)], "path string, timestamp string, hash string")
    assert {r.timestamp: r.version for r in snapshots.versions(df).collect()} == {"1": "v1", "2": "v2", "3": "v1", "4": "?"}


def test_cursor_rotation(spark):
    df = spark.createDataFrame([(i, f"u{i % 3}") for i in range(6)], "ord int, user string")
    assert [r.ord for r in log.after_cursor(df, user="u1").orderBy("ord").collect()] == [2, 3, 4, 5]
    assert log.after_cursor(df, user="gone").count() == 6


@pytest.mark.parametrize("path, out", [("a/b.md", True), ("", False), ("/a", False), ("a/../b", False), ("a\\..\\b", False), ("a\0b", False), (None, False), ("a..b", True)])
def test_safe_path(spark, path, out):
    assert spark.createDataFrame([(path,)], "p string").select(rules.safe_path(F.col("p"))).first()[0] is out


