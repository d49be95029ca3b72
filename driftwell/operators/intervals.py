"""History of paths as intervals: a row for each stretch of snapshots in which a path kept its content.

A path that does not change in a thousand snapshots is one row, not a thousand.  Snapshots are numbered by time; an
interval has the first and the last number, so a view of one moment is a range filter, and a new snapshot changes only
the intervals that were open.  Rows with a null path take no part; a path is in a snapshot once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INTERVAL = "path string, hash string, first bigint, last bigint"


def numbered(snapshots: DataFrame) -> DataFrame:
    """(timestamp, n) from 1 by time, each time once.  A row a snapshot, so one task orders them."""
    return snapshots.where("timestamp is not null").select("timestamp").distinct().select("timestamp", F.row_number().over(Window.orderBy("timestamp")).cast("bigint").alias("n"))


def intervals(files: DataFrame, numbers: DataFrame) -> DataFrame:
    """(path, hash, first, last) of files (timestamp, path, hash): a new interval starts where the hash changes or a snapshot is missed.

    Two null hashes are equal.  One exchange and one sort, by path; snapshots that have no number are left out.
    """
    by_path = Window.partitionBy("path").orderBy("n")
    rows = files.where("path is not null").join(F.broadcast(numbers), "timestamp").select("path", "hash", "n")
    apart = lambda other, step: ~F.coalesce(F.col("hash").eqNullSafe(other("hash").over(by_path)) & (other("n").over(by_path) == F.col("n") + step), F.lit(False))
    ends = rows.select("*", apart(F.lag, -1).alias("starts"), apart(F.lead, 1).alias("ends")).where("starts or ends")
    last = F.when(F.col("ends"), F.col("n")).otherwise(F.lead("n").over(by_path))
    return ends.withColumn("last", last).where("starts").select("path", "hash", F.col("n").alias("first"), "last")


def of_changes(changes: DataFrame, numbers: DataFrame) -> DataFrame:
    """The intervals of a history told by its changes (timestamp, path, hash): a file stays as it is until a later snapshot brings it anew.

    What ``intervals`` says of the files of all snapshots, without making them: a row for each change is sorted, not one
    for each file of each snapshot.  Changes that lie by path already are not exchanged.
    """
    by_path = Window.partitionBy("path").orderBy("timestamp")
    newest = numbers.select("timestamp", "n", F.max("n").over(Window.partitionBy()).alias("newest"))  # a row a snapshot
    rows = changes.where("path is not null").join(F.broadcast(newest), "timestamp")
    same = F.col("hash").eqNullSafe(F.lag("hash").over(by_path)) & F.lag("n").over(by_path).isNotNull()
    starts = rows.withColumn("same", same).where("not same")
    return starts.select("path", "hash", F.col("n").alias("first"), F.coalesce(F.lead("n").over(by_path) - 1, F.col("newest")).alias("last"))


def extended(known: DataFrame, added: DataFrame, n: int) -> DataFrame:
    """The intervals with one more snapshot, number ``n``, of (path, hash): only intervals that end at ``n - 1`` can grow.

    ``added`` has a path once.
    """
    done, open_ = known.where(F.col("last") < n - 1), known.where(F.col("last") >= n - 1)
    new = added.where("path is not null").select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("there"))
    both = open_.join(new, "path", "full_outer").withColumn("same", F.coalesce(F.col("hash").eqNullSafe(F.col("new_hash")) & F.col("there") & F.col("first").isNotNull(), F.lit(False)))
    grown = F.when(F.col("first").isNotNull(), F.struct("path", "hash", "first", F.when(F.col("same"), F.lit(n)).otherwise(F.col("last")).cast("bigint").alias("last")))
    begun = F.when(F.col("there") & ~F.col("same"), F.struct("path", F.col("new_hash").alias("hash"), F.lit(n).cast("bigint").alias("first"), F.lit(n).cast("bigint").alias("last")))
    return done.union(both.select(F.explode(F.array_compact(F.array(grown, begun))).alias("i")).select("i.*"))


def as_of(history: DataFrame, numbers: DataFrame, target: str) -> DataFrame:
    """(rel_path, identifier) of the newest snapshot not after ``target``; none before the first.  The number goes into the scan as a filter."""
    n = numbers.where(F.col("timestamp") <= target).agg(F.max("n")).first()[0] or 0
    return history.where((F.col("first") <= n) & (F.col("last") >= n)).select(F.col("path").alias("rel_path"), F.coalesce("hash", F.lit("")).alias("identifier"))


def expanded(history: DataFrame, numbers: DataFrame) -> DataFrame:
    """(timestamp, path, hash): the files of all snapshots again."""
    return history.select("path", "hash", F.explode(F.sequence("first", "last")).alias("n")).join(F.broadcast(numbers), "n").select("timestamp", "path", "hash")


def counts(history: DataFrame) -> DataFrame:
    """(path, versions, appearances) without expanding anything."""
    return history.groupBy("path").agg(F.countDistinct("hash").alias("versions"), F.sum(F.col("last") - F.col("first") + 1).alias("appearances"))


def labelled(history: DataFrame, dealt: bool = False) -> DataFrame:
    """(path, hash, first, last, version): a path's hashes numbered by first appearance; a null hash is ``?``.

    A hash that comes back has its old label.  Other columns come along.  A history whose rows lie by path (``dealt``), as
    ``intervals`` and ``of_changes`` leave them, is not exchanged again.
    """
    start = F.min("first").over(Window.partitionBy("path", "hash"))
    number = F.dense_rank().over(Window.partitionBy("path", F.col("hash").isNull()).orderBy("start"))
    rows = (history if dealt else history.repartition("path")).withColumn("start", start)
    return rows.select(*history.columns, F.when(F.col("hash").isNull(), "?").otherwise(F.concat(F.lit("v"), number.cast("string"))).alias("version"))


def versions(history: DataFrame, numbers: DataFrame, dealt: bool = False) -> DataFrame:
    """(path, timestamp, version) of every appearance, from labels of intervals."""
    rows = labelled(history, dealt).select("path", "version", F.explode(F.sequence("first", "last")).alias("n"))
    return rows.join(F.broadcast(numbers), "n").select("path", "timestamp", "version")


def transitions(history: DataFrame, dealt: bool = False) -> DataFrame:
    """(path, first, last, version, changed): whether an interval's newest appearance differs from the one after it; all its other ones do not.

    A path's labels are equal where its hashes are, so hashes are compared, before any row has a label.
    """
    after = F.lead("hash").over(Window.partitionBy("path").orderBy("first"))
    rows = (history if dealt else history.repartition("path")).withColumn("changed", F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(after))
    return labelled(rows, True).select("path", "first", "last", "version", "changed")
