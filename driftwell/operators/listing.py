"""A tree listing as numbered lines, without one task that holds them all.

Entries are put in the order of the listing by a range partition of their sort keys; the number of a line is its place in
its partition plus the sizes of the partitions before.  Which entries are the last of their folder is a maximum by folder,
so a folder with very many entries is never ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.text import human_size
from driftwell.sources.commits import shared_dir

#: What stands before an entry (last of its folder or not), and before the entries below it.
GLYPHS = {False: ("└── ", "├── ", "    ", "│   "), True: ("\\-- ", "+-- ", "    ", "|   ")}


def _below(files: DataFrame, folder: str) -> DataFrame:
    """The files below a folder, or the file itself, with ``parts``, their names from there on; empty names do not count."""
    above = [p for p in folder.split("/") if p]
    parts = F.filter(F.split("rel_path", "/"), lambda x: x != "")
    rows = files.where("rel_path is not null").withColumn("parts", parts)
    rows = rows.where(F.slice("parts", 1, len(above)) == F.array(*map(F.lit, above))) if above else rows
    return rows.withColumn("parts", F.slice("parts", len(above) + 1, F.greatest(F.size("parts") - len(above), F.lit(0))))


def entries(files: DataFrame, folder: str = "") -> DataFrame:
    """(path, parent, name, level, is_dir, size, modified, key) of all that is below a folder; ``key`` sorts entries as the listing has them.

    Directories come first, then names without regard to case, then names.  A path that is a file and has others below it is a
    directory.  Of a file that comes twice the larger size and later time count.
    """
    rows = _below(files, folder)
    modified = F.col("modified") if "modified" in files.columns else F.lit(None).cast("string")
    each = rows.select("parts", "size", modified.alias("modified")).where("size(parts) > 0").select(F.explode(F.expr("transform(sequence(1, size(parts)), i -> struct(slice(parts, 1, i) as parts, i < size(parts) as is_dir))")).alias("e"), "size", "modified")
    own = lambda c: F.max(F.when(~F.col("e.is_dir"), F.col(c)))
    known = each.groupBy("e.parts").agg(F.bool_or("e.is_dir").alias("is_dir"), own("size").alias("size"), own("modified").alias("modified"))
    n = F.size("parts")
    key = F.transform("parts", lambda x, i: F.struct((~F.col("is_dir") & (i == n - 1)).alias("file"), F.lower(x).alias("lower"), x.alias("name")))
    return known.select(
        F.array_join("parts", "/").alias("path"), F.array_join(F.slice("parts", 1, n - 1), "/").alias("parent"), F.element_at("parts", -1).alias("name"), n.alias("level"), "is_dir",
        F.coalesce("size", F.lit(0)).alias("size"), "modified", key.alias("key"),
    )


def numbered(rows: DataFrame, key: str = "key") -> DataFrame:
    """The rows with ``n``, their place from 1 by ``key``; written once in that order, so that numbers and rows agree.  Keys are distinct."""
    spark, at = rows.sparkSession, shared_dir(rows.sparkSession)
    place = rows.repartitionByRange(key).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    place.write.parquet(at)
    stored = spark.read.schema(place.schema).parquet(at)
    sizes = stored.groupBy("_part").agg(F.count("*").alias("n")).collect()  # a row a partition
    before, starts = 0, []
    for part, n in sorted(map(tuple, sizes)):
        starts.append((part, before))
        before += n
    known = F.broadcast(spark.createDataFrame(starts, "_part int, _before bigint"))
    return stored.join(known, "_part").select(*rows.columns, (F.col("_before") + F.col("_row") + 1).alias("n"))


def render(files: DataFrame, folder: str = "", depth: int | None = None, sizes: bool = True, times: bool = False, ascii_only: bool = False, root: str = ".") -> DataFrame:
    """(n, line): the listing of a folder as lines from 0, with the root's label, the entries down to ``depth`` levels, how many files are hidden, a blank line and the totals.

    A folder that is not there is an error; the root may be empty.  ``files`` has rel_path, size and, for times, modified (text).
    """
    found = entries(files, folder)
    if folder.strip("/") and _below(files, folder).isEmpty():
        raise FileNotFoundError(folder)
    last_mark, mark, gap, bar = GLYPHS[ascii_only]
    level = F.col("level")
    shown = numbered(found if depth is None else found.where(level <= depth))
    final = shown.groupBy(F.col("parent").alias("of")).agg(F.max_by("path", "n").alias("path")).select("path", F.lit(True).alias("is_last"))
    marked = shown.join(final, "path", "left").withColumn("is_last", F.coalesce("is_last", F.lit(False)))
    # the folders above an entry say what stands before it
    above = marked.where("level > 1").select("path", F.explode(F.expr("transform(sequence(1, level - 1), i -> struct(i as at, array_join(slice(split(path, '/'), 1, i), '/') as folder))")).alias("a"))
    folders = marked.where("is_dir").select(F.col("path").alias("folder"), F.when(F.col("is_last"), gap).otherwise(bar).alias("sign"))
    signs = above.select("path", "a.at", "a.folder").join(folders, "folder").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sign"))), lambda x: x["sign"]), "").alias("before"))
    size = F.when(~F.col("is_dir"), F.concat(F.lit("  "), human_size(F.col("size")))) if sizes else F.lit("")
    time = F.when(~F.col("is_dir") & (F.coalesce("modified", F.lit("")) != ""), F.concat(F.lit("  "), F.col("modified"))) if times else F.lit("")
    label = F.concat("name", F.when(F.col("is_dir"), "/").otherwise(""), F.coalesce(size, F.lit("")), F.coalesce(time, F.lit("")))
    lines = marked.join(signs, "path", "left").select("n", F.concat(F.coalesce("before", F.lit("")), F.when(F.col("is_last"), last_mark).otherwise(mark), label).alias("line"))
    hidden = F.count_if(~F.col("is_dir") & (level > depth)) if depth is not None else F.lit(0).cast("bigint")
    listed = F.count("*") if depth is None else F.count_if(level <= depth)
    about = found.agg(F.count_if("is_dir").alias("dirs"), F.count_if(~F.col("is_dir")).alias("files"), F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size"))), F.lit(0)).alias("bytes"), hidden.alias("hidden"), listed.alias("listed"))
    total = F.concat(F.col("dirs").cast("string"), F.lit(" directories, "), F.col("files").cast("string"), F.lit(" files"))
    total = F.when(F.col("files") > 0, F.concat(total, F.lit(" ("), human_size(F.col("bytes")), F.lit(" total)"))).otherwise(total) if sizes else total
    more = F.when(F.col("hidden") > 0, F.concat(F.lit("... ("), F.col("hidden").cast("string"), F.lit(" more files in subtrees)")))
    rest = F.array_compact(F.array(more, F.lit(""), total))
    foot = about.select("listed", F.posexplode(rest).alias("i", "line")).select((F.col("listed") + F.col("i") + 1).alias("n"), "line")
    head = files.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n"), F.lit(root).alias("line"))
    return head.union(lines).union(foot)
