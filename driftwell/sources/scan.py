"""Files below a folder as a table, listed folder by folder in parallel.

Spark's own file sources pass over names that begin with an underscore or a dot, which are files here like others; so
folders are listed in tasks, one level of the tree at a time.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import rules
from driftwell.sources.commits import shared_dir


def walk(spark: SparkSession, root: str, tasks: int = 64) -> DataFrame:
    """(rel_path, size, mtime_ns) of all files below ``root``, a path or URI that executors reach; links are followed.

    There is a job for each level, whose listing is a table in the shared folder that the next level starts from; no listing
    comes to the driver.  A folder that is one of those it was reached through (a link that leads back up) is left out, so
    loops of links end.  A root that is not there has no files.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        real = os.path.realpath if isinstance(place, pafs.LocalFileSystem) else lambda p: p
        for b in batches:
            for folder, above in zip(b["folder"], b["above"]):
                at = f"{base.rstrip('/')}/{folder}".rstrip("/")
                prefix, through, rows = f"{folder}/" if folder else "", [*above, real(at)], []
                for i in place.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                    is_dir = i.type == pafs.FileType.Directory
                    if not (is_dir and real(i.path) in through):
                        rows.append((prefix + i.base_name, is_dir, i.size, i.mtime_ns, through if is_dir else None))
                yield pd.DataFrame(rows, columns=["rel_path", "is_dir", "size", "mtime_ns", "above"])

    kinds = "rel_path string, is_dir boolean, size bigint, mtime_ns bigint, above array<string>"
    level, table, depth = spark.createDataFrame([("", [])], "folder string, above array<string>"), shared_dir(spark), 0
    while not level.isEmpty():
        level.repartition(tasks).mapInPandas(entries, kinds).write.parquet(f"{table}/level={depth}")
        level = spark.read.schema(kinds).parquet(f"{table}/level={depth}").where("is_dir").select(F.col("rel_path").alias("folder"), "above")
        depth += 1
    return spark.read.schema(kinds).parquet(*[f"{table}/level={k}" for k in range(depth)]).where("not is_dir").select("rel_path", "size", "mtime_ns")


def local_files(files: DataFrame, patterns: list[str], globs: list[str] = (), lines: list[str] = (), state: list[str] = (), rules_file: str | None = ".driftignore") -> DataFrame:
    """The files that a sync looks at: any of ``patterns`` takes them, no exclusion does, and they are no state files.

    ``patterns`` are paths as in a file browser: ``**/`` is any folders or none, ``*`` stops at a slash.  A snapshot's scan
    has no ignore rules, a prompt's scan has no exclusions at all (``rules_file`` null).  Each file comes once.
    """
    path = F.col("rel_path")
    wanted = files.where(path.rlike("|".join(map(browser_regex, patterns)))).where(~path.isin(list(state))) if patterns else files.limit(0)
    return (wanted if rules_file is None else wanted.where(~rules.excluded(path, list(globs), list(lines), rules_file))).dropDuplicates(["rel_path"])


def browser_regex(pattern: str) -> str:
    """A pattern of whole components as a regex; a component of two stars is any folders or none (at the end: any file)."""
    out, parts = "", pattern.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        out += (r"(?:[^/]+/)*" + ("[^/]+" if last else "")) if part == "**" else rules._translated(part, "[^/]*", "[^/]") + ("" if last else "/")
    return rf"\A{out}\z"


def with_digests(files: DataFrame, root: str) -> DataFrame:
    """The files with ``md5`` and ``sha256`` of their bytes, read in blocks in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        for b in batches:
            sums = []
            for p in b["rel_path"]:
                md5, sha = hashlib.md5(usedforsecurity=False), hashlib.sha256()
                with place.open_input_stream(f"{base.rstrip('/')}/{p}") as f:
                    while block := f.read(1 << 20):
                        md5.update(block)
                        sha.update(block)
                sums.append((md5.hexdigest(), sha.hexdigest()))
            yield b.assign(md5=[x for x, _ in sums], sha256=[x for _, x in sums])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{kinds}, md5 string, sha256 string")
