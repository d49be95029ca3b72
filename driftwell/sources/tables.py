"""File-state tables derived from the generic test tables by modular arithmetic and md5, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BACKENDS = ["drive", "dropbox", "sftp"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"),
        F.col("n_chars").alias("size"), F.md5("text").alias("h"),
    )


def local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, size, hash)."""
    edited = F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("h", F.lit("L")))).otherwise(F.col("h"))
    return _base(spark, sf_dir).where("doc_id % 10 <> 1").select("rel_path", "size", edited.alias("hash"))


def remote_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("h", F.lit("R")))).otherwise(F.col("h"))
    return _base(spark, sf_dir).where("doc_id % 11 <> 1").select("rel_path", "size", edited.alias("hash"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, synced_hash, synced_remote_hash); an empty remote hash stands for the synced one."""
    return _base(spark, sf_dir).where("doc_id % 13 <> 1").select("rel_path", F.col("h").alias("synced_hash"), F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.col("h")).alias("synced_remote_hash"))


def manifest_remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, backend, state, remote_hash, last_error, ord): one row for each seeded mirror of a file."""
    k = F.pmod(F.col("doc_id") + F.col("n"), F.lit(6))
    mirrors = F.posexplode(F.array(*map(F.lit, BACKENDS))).alias("n", "backend")
    state = F.when(k == 1, "pending_retry").when(k == 2, "failed_perm").otherwise("ok")
    error = F.when(k.isin(1, 2), F.concat(F.lit("error "), (F.col("doc_id") % 4).cast("string")))
    return (
        _base(spark, sf_dir).where("doc_id % 13 <> 1").select("*", mirrors).where(k != 0)
        .select("rel_path", "backend", state.alias("state"), F.when(F.col("doc_id") % 17 == 0, F.md5("h")).otherwise(F.col("h")).alias("remote_hash"), error.alias("last_error"), F.col("doc_id").alias("ord"))
    )


def sync_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, user, machine, action, ts, files, conflicts)."""
    e = F.col("event_id")
    files = F.expr("transform(sequence(1, 1 + event_id % 3), i -> concat('dir', cast((event_id + i) % 7 as string), '/f', cast((event_id * i) % 31 as string), '.md'))")
    return _read(spark, sf_dir, "events").select(
        e.alias("ord"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("machine"),
        F.col("event_type").alias("action"), "ts", files.alias("files"), (e % 10 == 0).cast("bigint").alias("conflicts"),
    )


#: Rows a task gets where many of them are sorted at once: Spark's own choice goes by compressed bytes, and these compress well.
ROWS_A_TASK = 500_000


def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, path, mark): the lines of each month of order dates, before the first one of a part becomes the file."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("mark"))
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("timestamp"))
    n = _tasks(lines)
    rows = lines.repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("timestamp", F.concat(F.lit("p"), (F.col("l_partkey") % 10).cast("string"), F.lit("/f"), F.col("l_partkey").cast("string")).alias("path"), "mark")


def _tasks(rows: DataFrame) -> int:
    """Tasks for the rows of a stored table; counting them reads file footers only."""
    return max(1, -(-rows.count() // ROWS_A_TASK))


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, path, hash): a snapshot for each month of order dates, the first line of a part in it is the file.

    Rows lie by path, so windows over a path's snapshots need no other exchange.
    """
    lines = snapshot_lines(spark, sf_dir).repartition(_tasks(_read(spark, sf_dir, "lineitem")), "path")
    return lines.groupBy("path", "timestamp").agg(F.min(F.md5("mark")).alias("hash")).select("timestamp", "path", "hash")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, tag): one for each day of order dates; every fiftieth day of a month that is a first has a tag."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _read(spark, sf_dir, "orders").select(day.alias("timestamp")).distinct().withColumn("tag", F.when(F.col("timestamp").endswith("-01-01"), F.concat(F.lit("v"), F.substring("timestamp", 1, 4))))


def blobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All stored hashes, and those that some manifest refers to."""
    d = _base(spark, sf_dir).where("h is not null")
    return d.select("h").distinct(), d.where("doc_id % 3 <> 0").select("h")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, files): events with none to twelve files."""
    files = F.expr("transform(filter(sequence(0, event_id % 13), i -> i > 0), i -> concat('f', i))")
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), files.alias("files"))


def many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, files, resolved): events with lists around the length at which they are cut."""
    files = F.expr("transform(sequence(1, 95 + event_id % 20), i -> concat('f', i))")
    out = _read(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), files.alias("files"))
    return out.withColumn("resolved", F.transform("files", lambda x: F.struct(x.alias("path"), F.lit("keep-local").alias("strategy"))))


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, size, mtime_ns, hash): local files with the time of their last change."""
    i = F.col("doc_id")
    edited = F.when(i % 7 == 0, F.md5(F.concat("h", F.lit("L")))).otherwise(F.col("h"))
    return _base(spark, sf_dir).where("doc_id % 10 <> 1").select("rel_path", "size", (i * 1000).alias("mtime_ns"), edited.alias("hash"))


def hash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, size, mtime_ns, md5, sha256): cached hashes, some of another time, some without SHA-256."""
    i = F.col("doc_id")
    return _base(spark, sf_dir).where("doc_id % 4 <> 1").select(
        "rel_path", "size", (i * 1000 + F.when(i % 9 == 0, 1).otherwise(0)).alias("mtime_ns"), F.col("h").alias("md5"), F.when(i % 5 == 0, "").otherwise(F.sha2("h", 256)).alias("sha256")
    )


def manifest_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, synced_hash, remote_file_id, synced_at, synced_remote_hash, remotes): whole manifest rows, mirrors as a map."""
    names = ["remote_file_id", "synced_remote_hash", "state", "last_error", "last_attempt", "intended_hash"]
    r = manifest_remotes(spark, sf_dir).select(
        "rel_path", "backend", F.struct(F.concat(F.lit("id"), F.col("ord").cast("string")).alias(names[0]), F.col("remote_hash").alias(names[1]), F.col("state").alias(names[2]), F.coalesce("last_error", F.lit("")).alias(names[3]), F.lit("").alias(names[4]), F.lit("").alias(names[5]), (F.col("ord") % 3).alias("attempts")).alias("r"),
    )
    maps = r.groupBy("rel_path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("backend", "r")))).alias("remotes"))
    flat = manifest(spark, sf_dir).select("rel_path", "synced_hash", F.lit("id").alias("remote_file_id"), F.lit("2026-05-01").alias("synced_at"), "synced_remote_hash")
    kind = maps.schema["remotes"].dataType.simpleString()
    return flat.join(maps, "rel_path", "left").withColumn("remotes", F.coalesce("remotes", F.create_map().cast(kind)))


def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text): a stored manifest for each source folder, of an old or a new format, one that is damaged, and unsafe paths."""
    i = F.col("doc_id")
    old = F.struct(F.col("h").alias("synced_hash"), F.concat(F.lit("old"), i.cast("string")).alias("drive_file_id"))
    new = F.struct(F.col("h").alias("synced_hash"), F.concat(F.lit("new"), i.cast("string")).alias("remote_file_id"), F.lit("").alias("synced_remote_hash"), F.create_map(F.lit("sftp"), F.struct(F.lit("failed_perm").alias("state"), (i % 4).alias("attempts"))).alias("remotes"))
    path = F.when(i % 17 == 0, F.concat(F.lit("../"), "rel_path")).otherwise(F.col("rel_path"))
    entry = F.concat(F.to_json(F.struct(path.alias("p"))).substr(F.lit(6), F.length(F.to_json(F.struct(path.alias("p")))) - 6), F.lit(":"), F.when(i % 2 == 0, F.to_json(old)).otherwise(F.to_json(new)))
    files = _base(spark, sf_dir).select(F.split_part("rel_path", F.lit("/"), F.lit(1)).alias("folder"), entry.alias("entry"))
    texts = files.groupBy("folder").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("entry")), ","), F.when(F.col("folder") == "src3", "").otherwise("}")).alias("text"))
    return texts.select("text")


def log_texts(spark: SparkSession, sf_dir: str, span: int = 1000) -> DataFrame:
    """(machine, part, text): a stored log for each machine, in parts of the events of ``span`` numbers each, with a field nobody knows."""
    e = F.struct("ord", "user", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "machine", "files", "action", F.lit("notes").alias("project"), F.lit(1).alias("future"))
    logs = sync_events(spark, sf_dir).groupBy("machine", F.floor(F.col("ord") / span).alias("part")).agg(F.sort_array(F.collect_list(e)).alias("events"))
    return logs.select("machine", "part", F.to_json(F.struct("events")).alias("text"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, backend, ord, state, intended_hash): uploads to mirrors in their order."""
    e = F.col("event_id")
    state = F.when(e % 23 == 0, "ok").when(e % 11 == 0, "failed_perm").otherwise("pending_retry")
    hash_ = F.when(e % 7 == 0, "").otherwise(F.concat(F.lit("h"), F.floor(e / 2500).cast("string")))
    return _read(spark, sf_dir, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("rel_path"), F.when(F.col("user_id") % 2 == 0, "sftp").otherwise("drive").alias("backend"), e.alias("ord"), state.alias("state"), hash_.alias("intended_hash"))


def stored_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(backend, name, content): stored bodies, some damaged, lost or misnamed."""
    i, name = F.col("doc_id"), F.sha2("text", 256)
    named = F.when(i % 13 == 0, F.upper(name)).otherwise(name)
    content = F.when(i % 11 != 0, F.when(i % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).cast("binary")
    return _read(spark, sf_dir, "documents").select(F.when(i % 2 == 0, "drive").otherwise("sftp").alias("backend"), named.alias("name"), content.alias("content"))


def snapshot_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, text): notes of snapshots, some damaged."""
    snaps = snapshots(spark, sf_dir)
    text = F.to_json(F.struct(F.lit("me@pc").alias("triggered_by"), F.when(F.col("timestamp") < "1995", "push").otherwise("sync").alias("action"), F.lit(3).alias("total_files"), F.coalesce("tag", F.lit("")).alias("tag"), F.array(F.lit("a.md")).alias("files_changed")))
    return snaps.select("timestamp", F.when(F.col("timestamp").endswith("-15"), F.lit("{damaged")).otherwise(text).alias("text"))
