"""Tables that lineage is cut at, in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``.  Where a session on one machine leaves it unset (tests), a folder under the
system's temporary one is set for the session; on a cluster that is an error, as executors share no such folder.  What is written there stays for as long as
the session may read it (results are lazy) and goes when the Python process ends, or with ``clean``.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new, unused URI below the shared folder."""
    base = spark.conf.get(_KEY, None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="driftwell-")
        spark.conf.set(_KEY, base)
    path = f"{base.rstrip('/')}/driftwell-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later stages restart from it, not from its inputs."""
    path = shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    # the shuffles of this write are of no use once the table is there; batches of long texts must not fill a worker
    ours = {_CLEANUP: "true"} | ({} if conf.get(_BATCH, None) else {_BATCH: str(4 << 20)})
    before = {k: conf.get(k, None) for k in ours}
    for k, v in ours.items():
        conf.set(k, v)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Removes the files of a table made by ``written`` that nothing reads any more."""
    files = df.inputFiles()
    for path in {f.rpartition("/")[0] for f in files}:
        remove(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@atexit.register
def clean() -> None:
    """Removes everything written so far."""
    while _made:
        spark, path = _made.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with the cluster's own cleaning
            return
