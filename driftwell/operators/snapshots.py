"""Snapshot diff, history, retention and orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import rules
from driftwell.functions.text import line_changes, snapshot_time


def diff(files: DataFrame, first: str, second: str, globs: list[str] = ()) -> DataFrame:
    """(path, change) between two snapshots: added, removed, modified or unchanged.

    ``latest`` is the newest snapshot there is.  With ``globs`` only paths that match one.  Null paths take no part; two
    null hashes are equal; a path is in a snapshot once.
    """
    rows = files.where("path is not null")
    rows = rows.where(rules.matches_any(F.col("path"), list(globs))) if globs else rows
    newest = files.agg(F.max("timestamp").alias("timestamp"))

    def side(name: str, mark: str) -> DataFrame:
        of = rows.join(F.broadcast(newest), "timestamp", "left_semi") if name == "latest" else rows.where(F.col("timestamp") == name)
        return of.select("path", F.col("hash").alias(mark), F.lit(True).alias(f"in_{mark}"))

    change = F.expr("case when in_a is null then 'added' when in_b is null then 'removed' when a <=> b then 'unchanged' else 'modified' end")
    return side(first, "a").join(side(second, "b"), "path", "full_outer").select("path", change.alias("change"))


def diff_lines(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, added, removed): with the lines of a diff of both texts (path, text); unchanged files are not compared."""
    texts = changes.where("change <> 'unchanged'").join(before.select("path", F.col("text").alias("a")), "path", "left").join(after.select("path", F.col("text").alias("b")), "path", "left")
    compared = texts.select("path", "change", line_changes(F.col("a"), F.col("b")).alias("n")).select("path", "change", "n.added", "n.removed")
    return compared.union(changes.where("change = 'unchanged'").select("path", "change", F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))


def versions(files: DataFrame, dealt: bool = False) -> DataFrame:
    """(path, timestamp, version): versions number a path's hashes by first appearance (ties by hash); null hashes have none.

    Rows that repeat are kept; null paths take no part.  Both windows use one exchange by path, and none if the rows lie
    by path already (``dealt``).
    """
    first = F.min("timestamp").over(Window.partitionBy("path", "hash"))
    number = F.dense_rank().over(Window.partitionBy("path", F.col("hash").isNull()).orderBy("first", "hash"))
    rows = files.where("path is not null")
    return (rows if dealt else rows.repartition("path")).withColumn("first", first).select("path", "timestamp", F.when(F.col("hash").isNull(), "?").otherwise(F.concat(F.lit("v"), number.cast("string"))).alias("version"))


def history_counts(files: DataFrame) -> DataFrame:
    """(path, versions, appearances): distinct hashes that are not null, and rows; null paths take no part."""
    return files.where("path is not null").groupBy("path").agg(F.countDistinct("hash").alias("versions"), F.count("*").alias("appearances"))


def keep_set(snapshots: DataFrame, last: int = 0, daily: int = 0, monthly: int = 0, yearly: int = 0) -> DataFrame:
    """Timestamps to keep: the newest of each of the newest days, months and years, and the last ones.

    One pass makes a row for each bucket a snapshot is in; buckets are as many as days, and of those the newest are ranked.
    Null times are kept nowhere; repeated ones are one.
    """
    wanted = {kind: (chars, n) for kind, chars, n in (("last", 64, last), ("daily", 10, daily), ("monthly", 7, monthly), ("yearly", 4, yearly)) if n > 0}
    if not wanted:
        return snapshots.select("timestamp").limit(0)
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.substring("timestamp", 1, chars).alias("bucket"), F.lit(n).alias("n")) for k, (chars, n) in wanted.items()]))
    newest = snapshots.where("timestamp is not null").select("timestamp", places.alias("b")).groupBy("b.kind", "b.bucket", "b.n").agg(F.max("timestamp").alias("timestamp"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("bucket")))
    return newest.withColumn("rank", rank).where("rank <= n").select("timestamp").distinct()


def prune(snapshots: DataFrame, **policy: int) -> DataFrame:
    """Timestamps to forget: not kept and without a tag; a policy of zeros forgets nothing."""
    if not any(policy.values()):
        return snapshots.select("timestamp").limit(0)
    return snapshots.where("tag is null").join(keep_set(snapshots, **policy), "timestamp", "left_anti").select("timestamp")


def orphans(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored hashes that nothing refers to, each once; null hashes are none.  Nothing referred to at all is taken for a fault: no orphans."""
    some = referenced.where("h is not null").limit(1).select(F.lit(1).alias("_some"))
    return stored.where("h is not null").join(referenced, "h", "left_anti").distinct().join(F.broadcast(some), how="cross").drop("_some")


def referenced(manifests: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """(h): the distinct hashes of all lists of blobs (timestamp, path, hash).  With any unreadable list it raises: its blobs would look like orphans."""
    if unreadable is not None and not unreadable.isEmpty():
        raise ValueError("a list of blobs cannot be read")
    return manifests.where("hash is not null").select(F.col("hash").alias("h")).distinct()


def upload_plan(local: DataFrame, stored: DataFrame) -> DataFrame:
    """(h, upload): each distinct local hash once, and whether its blob is still to be stored."""
    have = stored.where("h is not null").select("h", F.lit(True).alias("have")).distinct()
    return local.where("hash is not null").select(F.col("hash").alias("h")).distinct().join(have, "h", "left").select("h", F.col("have").isNull().alias("upload"))


def blob_snapshot(local: DataFrame, stored: DataFrame, timestamp: str) -> tuple[DataFrame, DataFrame]:
    """What a new snapshot writes: its list (timestamp, path, hash), and the hashes (h) whose bodies are not stored yet."""
    rows = local.where("rel_path is not null").select(F.lit(timestamp).alias("timestamp"), F.col("rel_path").alias("path"), "hash")
    return rows, upload_plan(local.where("rel_path is not null"), stored).where("upload").select("h")


def downloads(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, hash, id): files to fetch with their blob's id (the least of several), null where the blob is missing."""
    ids = blobs.groupBy(F.col("h").alias("hash")).agg(F.min("id").alias("id"))
    return files.where("path is not null and hash is not null").join(ids, "hash", "left").select("path", "hash", "id")


def checked_bodies(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, hash, content, intact): bodies of files to restore; one whose SHA-256 is another is not intact, nor is a missing one."""
    return files.join(blobs.select(F.col("h").alias("hash"), "content"), "hash", "left").select("path", "hash", "content", F.coalesce(F.sha2("content", 256) == F.col("hash"), F.lit(False)).alias("intact"))


def migration(source: DataFrame, target: DataFrame) -> DataFrame:
    """(timestamp, action): snapshots of one format that are in the other already are orphans, all others are to convert."""
    have = target.select("timestamp", F.lit(True).alias("have")).distinct()
    return source.select("timestamp").distinct().join(have, "timestamp", "left").select("timestamp", F.when(F.col("have"), "orphan").otherwise("convert").alias("action"))


def with_sizes(files: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, hash, size) of a snapshot's files; unknown sizes are 0.  ``sizes`` has a hash once."""
    return files.join(sizes.select("hash", "size"), "hash", "left").select("path", "hash", F.coalesce("size", F.lit(0)).alias("size"))


def first_source(copies: DataFrame) -> DataFrame:
    """For each timestamp the copy (timestamp, backend, format, priority) of the first backend that has one, lists of blobs before folders."""
    order = F.struct("priority", (F.col("format") != "blobs").alias("second"), "backend", "format")
    return copies.groupBy("timestamp").agg(F.min(order).alias("o")).select("timestamp", "o.backend", "o.format")


def transitions(history: DataFrame) -> DataFrame:
    """(path, timestamp, version, changed): newest first, whether a row's version differs from the one before; ``?`` never shows, but parts two rows."""
    before = F.lag("version").over(Window.partitionBy("path").orderBy(F.desc("timestamp")))
    return history.where("path is not null").select("path", "timestamp", "version", ((F.col("version") != "?") & ~F.col("version").eqNullSafe(before)).alias("changed"))


def tags(snapshots: DataFrame) -> DataFrame:
    """(tag): the distinct tags that are not empty."""
    return snapshots.where("coalesce(tag, '') <> ''").select("tag").distinct()


def tagged(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tag, timestamp): the newest snapshot with each wanted tag; an unknown tag has none."""
    newest = snapshots.where("tag is not null").groupBy("tag").agg(F.max("timestamp").alias("timestamp"))
    return wanted.select("tag").distinct().join(newest, "tag", "left")


def in_range(snapshots: DataFrame, first: str, last: str) -> DataFrame:
    """The snapshots whose time lies between both, ends included; bad names count as 1970."""
    at = snapshot_time(F.col("timestamp"))
    return snapshots.where(at.between(snapshot_time(F.lit(first)), snapshot_time(F.lit(last))))


def forget(snapshots: DataFrame, timestamps: list[str] | None = None, before: str | None = None, keep_last: int | None = None, keep_days: int | None = None, now=None) -> DataFrame:
    """(timestamp): what to forget by exactly one of four selectors; no more and no less than one is an error, as is keeping the last 0.

    Named snapshots go with or without a tag, tags shield from all other selectors.  ``before`` and ``keep_days`` go by the
    time in a name, and a bad name counts as 1970; ``keep_last`` by its text.
    """
    chosen = [x for x in (timestamps or None, before or None, keep_last or None, keep_days) if x is not None]
    if len(chosen) != 1 or (keep_last or 0) < 0 or (keep_days or 0) < 0:
        raise ValueError("name exactly one selector")
    if timestamps:
        return snapshots.where(F.col("timestamp").isin(timestamps)).select("timestamp")
    if keep_last:
        kept = snapshots.select("timestamp").orderBy(F.desc("timestamp")).limit(keep_last)
        old = snapshots.join(F.broadcast(kept.agg(F.min("timestamp").alias("edge"))), how="cross").where("timestamp < edge")
    else:
        edge = snapshot_time(F.lit(before)) if before else (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(keep_days))
        old = snapshots.where(snapshot_time(F.col("timestamp")) < edge)
    return old.where("coalesce(tag, '') = ''").select("timestamp")


def evicted(cache: DataFrame, budget: int) -> DataFrame:
    """(name): what an LRU cache (name, size, atime) drops, oldest first (ties by name), until the rest fits.

    Sizes are summed by the day of use first, so that no task orders the whole cache; within a day the running sum goes on
    from the days before.
    """
    rows = cache.withColumn("day", F.date_trunc("day", "atime"))
    days = rows.groupBy("day").agg(F.sum("size").alias("size"))  # a row a day
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("day", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("earlier"), F.sum("size").over(Window.partitionBy()).alias("total"))
    here = F.coalesce(F.sum("size").over(Window.partitionBy("day").orderBy("atime", "name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(before), "day").withColumn("gone", F.col("earlier") + here).where(F.col("total") - F.col("gone") > budget).select("name")


def union_formats(full: DataFrame, blobs: DataFrame) -> DataFrame:
    """Both kinds of snapshots; a time may be in both."""
    return full.select("timestamp", F.lit("full").alias("format")).unionByName(blobs.select("timestamp", F.lit("blobs").alias("format")))


def times(snapshots: DataFrame) -> DataFrame:
    """(timestamp): each time once."""
    return snapshots.select("timestamp").distinct()


def at_time(files: DataFrame, timestamp: str) -> DataFrame:
    """(path, identifier) of one snapshot; an unknown hash is empty."""
    return files.where(F.col("timestamp") == timestamp).select("path", F.coalesce("hash", F.lit("")).alias("identifier"))


def bodies(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """(h, content): the bodies of wanted hashes; one that is not stored has a null body."""
    return wanted.select("h").distinct().join(blobs.select("h", "content"), "h", "left")


def live_view(files: DataFrame, name: str) -> None:
    """Registers files (rel_path, size) as a view; registering again takes a new look."""
    files.select("rel_path", "size").createOrReplaceTempView(name)


def frozen_view(files: DataFrame, sizes: DataFrame, timestamp: str) -> DataFrame:
    """(rel_path, identifier, size) of one snapshot."""
    return with_sizes(files.where(F.col("timestamp") == timestamp), sizes).select(F.col("path").alias("rel_path"), F.coalesce("hash", F.lit("")).alias("identifier"), "size")


def mirror_view(remote: DataFrame, backend: str, known: list[str]) -> DataFrame:
    """The files of one backend; a name that is not known is an error."""
    if backend not in known:
        raise ValueError(f"unknown backend {backend}")
    return remote.where(F.col("backend") == backend)


def all_view(files: DataFrame) -> DataFrame:
    """(rel_path, identifier): the files of all snapshots, each below a folder of its snapshot's name."""
    return files.where("path is not null").select(F.concat("timestamp", F.lit("/"), "path").alias("rel_path"), F.coalesce("hash", F.lit("")).alias("identifier"))


def as_of_view(files: DataFrame, snapshots: DataFrame, target: str) -> DataFrame:
    """(rel_path, identifier) of the newest snapshot not after ``target``; none before the first."""
    newest = snapshots.where(F.col("timestamp") <= target).agg(F.max("timestamp").alias("timestamp"))
    return files.join(F.broadcast(newest), "timestamp", "left_semi").select(F.col("path").alias("rel_path"), F.coalesce("hash", F.lit("")).alias("identifier"))


def restore_plan(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action): files whose blob is missing are told apart."""
    have = stored.select(F.col("h").alias("hash"), F.lit(1).alias("have")).distinct()
    return files.join(have, "hash", "left").select("path", F.expr("case when have is null and hash is not null then 'missing-blob' else 'restore' end").alias("action"))


def as_of(snapshots: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, timestamp): the latest snapshot not after each target, null where there is none.

    Both sides are merged into one ordered stream, so no pairs are made.  The window runs by month, after the last
    snapshot of each earlier month has been carried over.
    """
    both = snapshots.select(F.col("timestamp").alias("at"), "timestamp", F.lit(False).alias("asks")).distinct().union(
        targets.select(F.col("target").alias("at"), F.lit(None).cast("string"), F.lit(True)).distinct()
    ).withColumn("month", F.substring("at", 1, 7))
    before = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)  # a row a month
    carried = both.groupBy("month").agg(F.max("timestamp").alias("last")).select("month", F.max("last").over(before).alias("carried"))
    here = F.last("timestamp", ignorenulls=True).over(Window.partitionBy("month").orderBy("at", "asks"))
    return both.withColumn("here", here).where("asks").join(F.broadcast(carried), "month").select(F.col("at").alias("target"), F.coalesce("here", "carried").alias("timestamp"))
