"""Tables of immutable folders behind numbered versions: readers see a whole version, writers never overwrite.

A write stages its rows in a folder of its own and then publishes the next version, a small file that names the folders
of every shard.  Publishing fails if somebody else has published that number first; the writer then looks whether the
other write touched its shards, and either puts its folders on top or merges again.  A crash leaves at most a staged
folder that no version names, for ``vacuum``.  The exclusive step is a hard link on a local disk and a rename that does
not overwrite elsewhere, which a distributed file system does atomically; an object store needs one with that promise.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CHECKPOINTS = "spark.checkpoint.dir"
_SHARD = "__shard"


def shared_dir(spark: SparkSession) -> str:
    """A new, unused URI below the folder that driver and executors share; a session on one machine may leave it unset."""
    base = spark.conf.get(_CHECKPOINTS, None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_CHECKPOINTS} to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="driftwell-")
        spark.conf.set(_CHECKPOINTS, base)
    return f"{base.rstrip('/')}/driftwell-{uuid.uuid4().hex}"


class Folder:
    """Small files in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(self._conf)
        self.path = path

    def _child(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._at, name)

    def names(self) -> list[str]:
        """Names of what is in the folder; none where there is no folder."""
        if not self._fs.exists(self._at):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at))

    def ages(self) -> dict[str, float]:
        """Seconds since each entry was last changed."""
        now = time.time()
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in self._fs.listStatus(self._at)} if self._fs.exists(self._at) else {}

    def read(self, name: str) -> str:
        stream = self._fs.open(self._child(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._child(name))

    def rename(self, name: str, to: str) -> None:
        if not self._fs.rename(self._child(name), self._child(to)):
            raise OSError(f"cannot rename {name} in {self.path}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._child(name), True)

    def create(self, name: str, text: str) -> bool:
        """Makes a file with all of its text at once; false, and nothing done, if there is one of that name already."""
        staged = self._child(f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(staged, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                java_path = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(java_path(self._child(name)), java_path(staged))
            else:
                options = self._jvm.org.apache.hadoop.fs.Options
                none = self._jvm.java.lang.reflect.Array.newInstance(options.Rename.NONE.getClass(), 1)
                none[0] = options.Rename.NONE
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self._conf)
                context.rename(staged, self._child(name), none)
        except Exception:  # noqa: BLE001  a Java error of any kind: what counts is whether somebody else made the file
            if self.exists(name):
                return False
            raise
        finally:
            self._fs.delete(staged, False)
        return True


@dataclass(frozen=True)
class Version:
    """A version's number, the folders of each shard, and the last transaction of each application in it."""

    number: int = 0
    shards: dict[str, list[str]] = field(default_factory=dict)
    transactions: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """Rows with a unique key, in ``shards`` by the key's hash; a write rewrites or adds to the shards that it touches.

    Rows with a null key take no part.  The number of shards belongs to the stored table: every writer names the same.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, key: str, shards: int = 64):
        self.spark, self.root, self.key, self.shards = spark, root.rstrip("/"), key, shards
        self.schema = spark.createDataFrame([], schema).schema
        self._versions, self._data = Folder(spark, f"{self.root}/versions"), Folder(spark, f"{self.root}/data")

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._versions.names() if re.fullmatch(r"\d{20}\.json", n)]

    def version(self, number: int | None = None) -> Version:
        """The newest version, or one by its number; number 0 is the empty table."""
        number = max(self.numbers(), default=0) if number is None else number
        return Version(**json.loads(self._versions.read(f"{number:020d}.json"))) if number else Version()

    def read(self, version: Version | None = None, only: set[str] | None = None) -> DataFrame:
        """All rows of a version, or those of some shards."""
        version = version or self.version()
        paths = [f"{self.root}/data/{f}" for k, folders in sorted(version.shards.items()) if only is None or k in only for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _touched(self, keys: DataFrame) -> set[str]:
        return {str(r[0]) for r in keys.where(F.col(self.key).isNotNull()).select(self.shard(F.col(self.key))).distinct().collect()}  # at most ``shards`` numbers

    def _stage(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows in a new folder: shard and folder of what there was to write.  Large shards are split over tasks."""
        name = uuid.uuid4().hex
        keyed = rows.where(F.col(self.key).isNotNull()).select(*self.schema.names, self.shard(F.col(self.key)).alias(_SHARD))
        keyed.hint("rebalance", _SHARD).write.partitionBy(_SHARD).parquet(f"{self.root}/data/{name}")
        return {n.partition("=")[2]: f"{name}/{n}" for n in Folder(self.spark, f"{self.root}/data/{name}").names() if n.startswith(f"{_SHARD}=")}

    def _commit(self, touched: set[str], rows: Callable[[Version], DataFrame], replace: bool, transaction: tuple[str, int] | None) -> Version:
        base, staged = self.version(), None
        while True:
            if transaction and base.transactions.get(transaction[0], -1) >= transaction[1]:
                return base
            if staged is None:
                staged = self._stage(rows(base))
            if not staged and not (replace and touched & base.shards.keys()) and not transaction:
                return base
            old = {k: v for k, v in base.shards.items() if not (replace and k in touched)}
            shards = old | {k: [*old.get(k, []), f] for k, f in staged.items()}
            new = Version(base.number + 1, shards, base.transactions | (dict([transaction]) if transaction else {}))
            if self._versions.create(f"{new.number:020d}.json", json.dumps(new.__dict__)):
                return new
            now = self.version()
            if any(now.shards.get(k) != base.shards.get(k) for k in touched):
                staged = None  # somebody changed the same shards: merge again, with their rows
            base = now

    def merge(self, rows: DataFrame, removed: DataFrame | None = None, transaction: tuple[str, int] | None = None) -> Version:
        """Publishes the table with ``rows`` put in by key, in place of stored ones, and the keys of ``removed`` gone.

        Stored rows that ``rows`` does not name stay, whoever wrote them.  A key twice in ``rows`` is an error.  A transaction
        (application, number) that is in the table already changes nothing.
        """
        gone = (rows.limit(0) if removed is None else removed).select(self.key)
        touched = self._touched(rows.select(self.key).union(gone))
        names = [c for c in self.schema.names if c != self.key]
        packed = lambda df, at: df.where(F.col(self.key).isNotNull()).select(self.key, F.struct(*[F.col(c) for c in names]).alias(at))

        def merged(base: Version) -> DataFrame:
            new = packed(rows, "new").groupBy(self.key).agg(F.any_value("new").alias("new"), F.count("*").alias("n"))
            new = new.select(self.key, F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("twice in one write: "), F.col(self.key).cast("string")))).otherwise(F.col("new")).alias("new"))
            both = packed(self.read(base, touched), "old").join(new, self.key, "full_outer").join(gone, self.key, "left_anti")
            return both.select(self.key, F.coalesce("new", "old").alias("x")).select(self.key, "x.*").select(*self.schema.names)

        return self._commit(touched, merged, True, transaction)

    def add(self, rows: DataFrame, transaction: tuple[str, int] | None = None, unique: bool = False) -> Version:
        """Publishes the table with those of ``rows`` whose key is not in it, one of each key; stored shards are not rewritten.

        Only stored keys are read.  If there is nothing to add there is no new version.  Rows that have a key once
        (``unique``) are shuffled by it only where stored keys are to be left out.
        """
        touched = self._touched(rows)

        def fresh(base: Version) -> DataFrame:
            once = rows if unique else rows.dropDuplicates([self.key])
            stored = touched & base.shards.keys()
            return (once.join(self.read(base, touched).select(self.key), self.key, "left_anti") if stored else once).select(*self.schema.names)

        return self._commit(touched, fresh, False, transaction)

    def vacuum(self, keep: int = 10, hours: float = 24) -> int:
        """Deletes versions before the newest ``keep`` and folders that no kept version names and nobody has changed for ``hours``; how many folders went."""
        numbers = sorted(self.numbers())
        for n in numbers[:-keep] if keep else []:
            self._versions.delete(f"{n:020d}.json")
        named = {f.partition("/")[0] for n in numbers[-keep:] for folders in self.version(n).shards.values() for f in folders}
        gone = [name for name, age in self._data.ages().items() if name not in named and age >= hours * 3600]
        for name in gone:
            self._data.delete(name)
        return len(gone)
