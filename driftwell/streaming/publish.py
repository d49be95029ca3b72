"""Publishing events from a stream: each goes to the log, the inbox and every route that takes it, exactly once.

A micro-batch is written to a folder of its own for each of the three, then one marker makes all of it visible.  A batch
that comes again after a crash overwrites its folders, or, if its marker is there, does nothing.  An event that was sent
twice, even in batches far apart, is known by its key among the published events of its day.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions.text import event_summary
from driftwell.operators import log as logs
from driftwell.sources import json_files
from driftwell.sources.commits import Folder

EVENT = "ord bigint, user string, machine string, action string, ts timestamp_ntz, files array<string>, project string"
LOG = f"{EVENT}, day string"
INBOX = "timestamp string, title string, message string, user string, machine string, action string, files array<string>, project string"
DELIVERIES = "ord bigint, route string, files array<string>, message string"
TARGETS = {"log": LOG, "inbox": INBOX, "deliveries": DELIVERIES}
#: What tells events apart.
KEY = ("ts", "user", "machine", "files")


def _key(prefix: str = "") -> Column:
    """The key as a text in which null differs from empty."""
    return F.to_json(F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in KEY]))


class Ledger:
    """The three tables below a folder, and which batches of them count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._marks = Folder(spark, f"{self.root}/marks")

    def folder(self, target: str, app: str, batch: int, kind: str = "batch") -> str:
        return f"{self.root}/{target}/app={app}/{kind}={batch:012d}"

    def committed(self, app: str, batch: int) -> bool:
        return self._marks.exists(f"{app}.{batch:012d}") or any(a == app and n >= batch for a, n in self._packed().items())

    def mark(self, app: str, batch: int) -> bool:
        return self._marks.create(f"{app}.{batch:012d}", json.dumps({"app": app, "batch": batch}))

    def _packed(self) -> dict[str, int]:
        """For each application, up to which batch its folders have been put together."""
        found: dict[str, int] = {}
        for app, n in re.findall(r"^(\S+)\.through\.(\d{12})$", "\n".join(self._marks.names()), re.M):
            found[app] = max(found.get(app, -1), int(n))
        return found

    def folders(self, target: str) -> list[str]:
        """The folders that hold published rows of a target."""
        packed = self._packed()
        single = [(a, int(n)) for a, n in re.findall(r"^(\S+)\.(\d{12})$", "\n".join(self._marks.names()), re.M) if not a.endswith(".through")]
        return [self.folder(target, a, n, "through") for a, n in packed.items()] + [self.folder(target, a, n) for a, n in single if n > packed.get(a, -1)]

    def read(self, target: str) -> DataFrame:
        """Published rows of ``log``, ``inbox`` or ``deliveries``; batches without a marker do not count."""
        paths = self.folders(target)
        schema = TARGETS[target]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self, app: str) -> int:
        """Puts the folders of an application's batches together, so that readers list few; how many there were.

        Readers that hold the old folders may go on until ``sweep``.  A batch that is being written is not touched.
        """
        names = "\n".join(self._marks.names())
        batches = [int(n) for n in re.findall(rf"^{re.escape(app)}\.(\d{{12}})$", names, re.M)]
        last, before = max(batches, default=-1), self._packed().get(app, -1)
        if last <= before:
            return 0
        own = [(before, "through")] * (before >= 0) + [(n, "batch") for n in sorted(batches) if n > before]
        for target, schema in TARGETS.items():
            rows = self.spark.read.schema(schema).parquet(*[self.folder(target, app, n, kind) for n, kind in own])
            rows.write.mode("overwrite").parquet(self.folder(target, app, last, "through"))
        self._marks.create(f"{app}.through.{last:012d}", "{}")
        return len(own)

    def sweep(self, app: str) -> None:
        """Deletes what ``compact`` has made superfluous."""
        last = self._packed().get(app, -1)
        for target in TARGETS:
            here = Folder(self.spark, f"{self.root}/{target}/app={app}")
            for name in here.names():
                kind, _, n = name.partition("=")
                if int(n) < last or kind == "batch" and int(n) <= last:
                    here.delete(name)
        for name in self._marks.names():
            single = re.fullmatch(rf"{re.escape(app)}\.(\d{{12}})", name)
            old = re.fullmatch(rf"{re.escape(app)}\.through\.(\d{{12}})", name)
            if single and int(single[1]) <= last or old and int(old[1]) < last:
                self._marks.delete(name)


def publisher(root: str, app: str, routes: list[tuple[str, list[str], list[str]]], title: str = "sync", machine: str | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that publishes events (ord, user, machine, action, ts, files, project) below ``root``.

    Names of applications are one word of letters, digits and ``_``; a new application publishes batches of its own, and
    events that another one has published stay published once.  Two applications at once may each publish an event that is
    sent to both.  Events of ``machine`` are in the log and on routes but not in the inbox.  Lists of files are cut as in
    any log.  Rows without a time are kept, under a day of their own.
    """
    if not re.fullmatch(r"\w+", app):
        raise ValueError("an application's name is one word")

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ledger = Ledger(spark, root)
        if ledger.committed(app, number):
            return
        day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none"))
        new = batch.select(*[c.split(" ")[0] for c in EVENT.split(", ")]).withColumn("files", json_files.capped_files(F.col("files")))
        new = logs.once(new).withColumn("day", day).withColumn("k", _key())
        days = [r[0] for r in new.select("day").distinct().collect()]
        known = ledger.read("log").where(F.col("day").isin(days)).select(_key().alias("k"))
        fresh = new.join(known, "k", "left_anti").select(*[c.split(" ")[0] for c in LOG.split(", ")])
        at = {t: ledger.folder(t, app, number) for t in TARGETS}
        fresh.sortWithinPartitions("day").write.mode("overwrite").parquet(at["log"])
        stored = spark.read.schema(LOG).parquet(at["log"])  # what follows is made of what the log says
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
        message = event_summary("user", "machine", "action", "files", F.coalesce("project", F.lit("")), F.coalesce(stamp, F.lit("")))
        heard = stored if machine is None else logs.others(stored, machine)
        heard.select(stamp.alias("timestamp"), F.lit(title).alias("title"), message.alias("message"), "user", "machine", "action", "files", "project").write.mode("overwrite").parquet(at["inbox"])
        sent = logs.routed(stored, routes, ("user", "machine", "action", "ts", "project")) if routes else spark.createDataFrame([], f"{EVENT}, route string")
        sent.select("ord", "route", "files", message.alias("message")).write.mode("overwrite").parquet(at["deliveries"])
        ledger.mark(app, number)

    return publish
