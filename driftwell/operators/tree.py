"""Directory sizes and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.rules import normal_path


def rollup(files: DataFrame) -> DataFrame:
    """(prefix, size, file_count) of every directory and file; the root is the empty prefix.  Null paths are left out."""
    prefixes = F.expr("transform(sequence(0, size(parts)), i -> array_join(slice(parts, 1, i), '/'))")
    parts = F.filter(F.split("rel_path", "/"), lambda x: x != "")
    return files.where("rel_path is not null").select(parts.alias("parts"), "size").select(F.explode(prefixes).alias("prefix"), F.coalesce("size", F.lit(0)).alias("size")).groupBy("prefix").agg(
        F.sum("size").alias("size"), F.count("*").alias("file_count")
    )


def rollup_changed(sums: DataFrame, changes: DataFrame) -> DataFrame:
    """``rollup`` kept up to date: the sums (prefix, size, file_count) after changes (rel_path, old_size, new_size, was, is).

    ``was`` and ``is`` say whether a file was there before and is there now; an unknown size is 0.  Signed differences go up
    the folders of changed files only; what is left without files is gone, the root stays.  The work is that of the changes
    and one join by prefix.
    """
    parts = F.filter(F.split("rel_path", "/"), lambda x: x != "")
    size = F.when(F.col("is"), F.coalesce("new_size", F.lit(0))).otherwise(0) - F.when(F.col("was"), F.coalesce("old_size", F.lit(0))).otherwise(0)
    moved = changes.where("rel_path is not null").select(parts.alias("parts"), size.alias("size"), (F.col("is").cast("bigint") - F.col("was").cast("bigint")).alias("n"))
    up = moved.select(F.explode(F.expr("transform(sequence(0, size(parts)), i -> array_join(slice(parts, 1, i), '/'))")).alias("prefix"), "size", "n")
    deltas = up.groupBy("prefix").agg(F.sum("size").alias("d_size"), F.sum("n").alias("d_n"))
    both = sums.join(deltas, "prefix", "full_outer")
    new = both.select("prefix", (F.coalesce("size", F.lit(0)) + F.coalesce("d_size", F.lit(0))).alias("size"), (F.coalesce("file_count", F.lit(0)) + F.coalesce("d_n", F.lit(0))).alias("file_count"))
    return new.where("file_count <> 0 or prefix = ''")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rel_path, old_size, new_size, was, is) of files (rel_path, size) that came, went or changed their size; a path is in each once."""
    side = lambda df, size, mark: df.where("rel_path is not null").select("rel_path", F.col("size").alias(size), F.lit(True).alias(mark))
    both = side(before, "old_size", "was").join(side(after, "new_size", "is"), "rel_path", "full_outer")
    both = both.select("rel_path", "old_size", "new_size", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("is", F.lit(False)).alias("is"))
    return both.where("was <> is or not (old_size <=> new_size)")


def largest(files: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest paths, files and directories, ties by path."""
    return rollup(files).where("prefix <> ''").orderBy(F.desc("size"), "prefix").limit(max(0, n)).select("prefix", "size")


def children(files: DataFrame, folder: str) -> DataFrame:
    """Immediate children of a folder."""
    head = folder.rstrip("/") + "/" if folder else ""
    return files.where(F.col("rel_path").startswith(head)).select(F.split_part(F.substring("rel_path", len(head) + 1, 1 << 20), F.lit("/"), F.lit(1)).alias("name")).distinct()


def subtree_counts(files: DataFrame) -> DataFrame:
    """(prefix, dirs, files, bytes) of every directory: the directories below it, the files, their bytes; a path that comes twice counts once, with its last size by size.

    Null paths are left out; the root is the empty prefix.
    """
    parts = F.filter(F.split("rel_path", "/"), lambda x: x != "")
    once = files.where("rel_path is not null").groupBy(parts.alias("parts")).agg(F.max(F.coalesce("size", F.lit(0))).alias("size")).where("size(parts) > 0")
    up = once.select(F.explode(F.expr("transform(sequence(0, size(parts) - 1), i -> struct(array_join(slice(parts, 1, i), '/') as prefix, i as depth))")).alias("p"), "parts", "size")
    sums = up.groupBy("p.prefix").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    folders = up.select("p.prefix", "p.depth").distinct().where("depth > 0")
    above = folders.select(F.explode(F.expr("transform(sequence(0, depth - 1), i -> array_join(slice(split(prefix, '/'), 1, i), '/'))")).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("dirs"))
    return sums.join(above, "prefix", "left").select("prefix", F.coalesce("dirs", F.lit(0)).alias("dirs"), "files", "bytes")


def totals(files: DataFrame) -> DataFrame:
    """One row (files, bytes) of a whole listing."""
    return files.where("rel_path is not null").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def tree_rank(files: DataFrame) -> DataFrame:
    """(prefix, is_dir, rank) among the entries of one folder: directories first, then by name without regard to case, then by name."""
    parts = F.filter(F.split("rel_path", "/"), lambda x: x != "")
    entries = files.where("rel_path is not null").select(parts.alias("parts")).where("size(parts) > 0").select(
        F.explode(F.expr("transform(sequence(1, size(parts)), i -> struct(array_join(slice(parts, 1, i - 1), '/') as parent, parts[i - 1] as name, i < size(parts) as is_dir))")).alias("e")
    ).groupBy("e.parent", "e.name").agg(F.bool_or("e.is_dir").alias("is_dir"))
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("is_dir"), F.lower("name"), "name"))
    return entries.select(F.concat_ws("/", F.nullif("parent", F.lit("")), "name").alias("prefix"), "is_dir", rank.cast("bigint").alias("rank"))


def subtree(files: DataFrame, folder: str) -> DataFrame:
    """The files below a folder, or the file itself; the empty folder is the root."""
    at = folder.strip("/")
    return files.where("rel_path is not null") if not at else files.where((F.col("rel_path") == at) | F.col("rel_path").startswith(f"{at}/"))


#: Fixed value: how many rows a listing may have.
MOST_ROWS = 1_000_000


def guarded_listing(files: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The listing, or an error if it has more than ``most`` rows."""
    n = files.agg(F.count("*").alias("n")).select(F.when(F.col("n") > most, F.raise_error(F.lit(f"more than {most} rows"))).otherwise(True).alias("ok"))
    return files.join(F.broadcast(n), how="cross").where("ok").drop("ok")


def stat(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, kind, size) of asked paths: a file, a directory (something is below it; the root is one), or null where there is nothing."""
    known = rollup(files).select("prefix", "size", "file_count")
    own = files.where("rel_path is not null").groupBy("rel_path").agg(F.max("size").alias("own"))
    asked = paths.select("path", normal_path(F.col("path")).alias("prefix"))
    seen = asked.join(known, "prefix", "left").join(own.select(F.col("rel_path").alias("prefix"), "own", F.lit(True).alias("file")), "prefix", "left")
    kind = F.when(F.col("file"), "file").when(F.col("file_count").isNotNull() | (F.col("prefix") == ""), "dir")
    return seen.select("path", kind.alias("kind"), F.when(kind == "file", F.coalesce("own", F.lit(0))).alias("size"))


def readdir(files: DataFrame, folder: str) -> DataFrame:
    """(name): ``.``, ``..`` and the children of a folder; a file or nothing is an error."""
    at = folder.strip("/")
    kind = stat(files, files.sparkSession.createDataFrame([(at,)], "path string")).first().kind
    if kind != "dir":
        raise NotADirectoryError(at) if kind else FileNotFoundError(at)
    return files.sparkSession.createDataFrame([(".",), ("..",)], "name string").union(children(files, at))


def byte_range(content: Column, offset: int, size: int) -> Column:
    """``size`` bytes from ``offset``; negative numbers count as 0."""
    return F.substring(content, max(0, offset) + 1, max(0, size))


def sibling_rank(files: DataFrame) -> DataFrame:
    """(prefix, rank) among the paths of one folder, by size."""
    parent = F.regexp_replace("prefix", "/?[^/]*$", "")
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("size"), "prefix"))
    return rollup(files).where("prefix <> ''").withColumn("parent", parent).select("prefix", rank.cast("bigint").alias("rank"))
