"""Stored state as JSON: readers from texts to tables, and writers back.

A reader takes a DataFrame with one file's text a row (``spark.read.text(path, wholetext=True)``, or ``binaryFile`` cast
to text), so one call reads any number of files.  A file that is no JSON object counts as empty; ``unreadable`` lists
such files, for callers that must not go on without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import rules

REMOTE = "remote_file_id string, synced_remote_hash string, state string, last_error string, last_attempt string, intended_hash string, attempts bigint"
_ENTRY = f"synced_hash string, remote_file_id string, drive_file_id string, synced_at string, synced_remote_hash string, remotes map<string, struct<{REMOTE.replace(' string', ':string').replace(' bigint', ':bigint')}>>"
EVENT = "machine string, user string, timestamp string, files array<string>, action string, project string, auto_resolved_files array<struct<path:string,strategy:string>>"
#: How many events a log keeps, and files an event.
LOG_EVENTS, EVENT_FILES = 200, 100


def read_texts(spark, path: str) -> DataFrame:
    """(file, text) of the files below a path or glob, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def unreadable(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text is no JSON object."""
    return texts.where(F.from_json(text_col, "map<string,string>").isNull())


def manifest(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each path of stored manifests, of any of the three formats; unsafe paths are left out.

    What a format does not have is empty; an older name of the file's id is read where the newer one is not there, and
    the remote hash is the synced one where it was never written (an empty one that was written stays).  Other columns of
    ``texts`` come along.
    """
    rest = [c for c in texts.columns if c != text_col]
    raw = F.from_json(text_col, "map<string,string>")
    entry = F.from_json("v", f"struct<{_ENTRY_TYPE}>")
    rows = texts.select(*rest, F.explode(raw).alias("rel_path", "v")).where(rules.safe_path(F.col("rel_path"))).select(*rest, "rel_path", entry.alias("e"))
    none = F.lit("")
    remote = lambda _, r: F.struct(
        *[F.coalesce(r[k], F.lit("ok" if k == "state" else "")).alias(k) for k in ("remote_file_id", "synced_remote_hash", "state", "last_error", "last_attempt", "intended_hash")],
        F.coalesce(r["attempts"], F.lit(0)).cast("bigint").alias("attempts"),
    )
    remotes = F.transform_values(F.coalesce("e.remotes", F.create_map().cast(f"map<string,struct<{_REMOTE_TYPE}>>")), remote)
    return rows.select(
        *rest, "rel_path", F.coalesce("e.synced_hash", none).alias("synced_hash"), F.coalesce("e.remote_file_id", "e.drive_file_id", none).alias("remote_file_id"),
        F.coalesce("e.synced_at", none).alias("synced_at"), F.coalesce("e.synced_remote_hash", "e.synced_hash", none).alias("synced_remote_hash"), remotes.alias("remotes"),
    )


_REMOTE_TYPE = REMOTE.replace(" string", ":string").replace(" bigint", ":bigint").replace(", ", ",")
_ENTRY_TYPE = f"synced_hash:string,remote_file_id:string,drive_file_id:string,synced_at:string,synced_remote_hash:string,remotes:map<string,struct<{_REMOTE_TYPE}>>"


def remotes(manifest_: DataFrame) -> DataFrame:
    """A row for each path and backend of a manifest."""
    return manifest_.select("rel_path", F.explode("remotes").alias("backend", "r")).select("rel_path", "backend", "r.*")


def manifest_json(manifest_: DataFrame) -> DataFrame:
    """(rel_path, value): each row as its JSON in the newest format; an empty map of remotes is left out."""
    cells = [F.coalesce(c, F.lit("")).alias(c) for c in ("synced_hash", "remote_file_id", "synced_at", "synced_remote_hash")]
    return manifest_.select("rel_path", F.to_json(F.struct(*cells, F.when(F.size("remotes") > 0, F.col("remotes")).alias("remotes"))).alias("value"))


def write_manifest(manifest_: DataFrame, path: str) -> None:
    """JSON lines of ``{path: entry}``; a reader sees all of them or, until the job ends, none."""
    rows = manifest_json(manifest_).select(F.concat(F.lit("{"), F.to_json(F.array("rel_path")).substr(F.lit(2), F.length(F.to_json(F.array("rel_path"))) - 2), F.lit(":"), "value", F.lit("}")))
    rows.write.mode("overwrite").text(path)


def hash_cache(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(rel_path, size, mtime_ns, md5, sha256) of stored caches; entries of under three parts are left out, a missing SHA-256 is empty."""
    rows = texts.select(F.explode(F.from_json(text_col, "map<string,array<string>>")).alias("rel_path", "v")).where("size(v) >= 3")
    return rows.select(
        "rel_path", F.col("v")[0].cast("bigint").alias("size"), F.col("v")[1].cast("bigint").alias("mtime_ns"), F.col("v")[2].alias("md5"),
        F.coalesce(F.try_element_at("v", F.lit(4)), F.lit("")).alias("sha256"),
    )


def capped(items: Column, more, most: int = EVENT_FILES) -> Column:
    """The first ``most`` items and one that ``more`` makes of how many were left out; null is none."""
    n = F.size(items)
    return F.when(n > most, F.concat(F.slice(items, 1, most), F.array(more(n - most)))).otherwise(items)


def capped_files(files: Column, most: int = EVENT_FILES) -> Column:
    return F.coalesce(capped(files, lambda n: F.concat(F.lit("... and "), n.cast("string"), F.lit(" more")), most), F.array().cast("array<string>"))


def capped_resolved(entries: Column, most: int = EVENT_FILES) -> Column:
    more = lambda n: F.struct(F.concat(F.lit("... and "), n.cast("string"), F.lit(" more")).alias("path"), F.lit("").alias("strategy"))
    return F.coalesce(capped(entries, more, most), F.array().cast("array<struct<path:string,strategy:string>>"))


def _event(value: str, most: int) -> list[Column]:
    cells = [F.col(f"{value}.{c}") for c in ("machine", "user", "timestamp", "action", "project")]
    return [*cells, capped_files(F.col(f"{value}.files"), most).alias("files"), capped_resolved(F.col(f"{value}.auto_resolved_files"), most).alias("auto_resolved_files")]


def sync_log(texts: DataFrame, text_col: str = "text", most: int = EVENT_FILES) -> DataFrame:
    """A row for each event of stored logs, ``ord`` its place; unknown fields are dropped, lists cut again, bad events left out."""
    rest = [c for c in texts.columns if c != text_col]
    parsed = F.from_json(text_col, f"events array<struct<{EVENT.replace(' string', ':string').replace(' array', ':array')}>>")
    return texts.select(*rest, F.posexplode(parsed["events"]).alias("ord", "e")).where("e is not null").select(*rest, F.col("ord").cast("bigint").alias("ord"), *_event("e", most))


def sync_log_parts(texts: DataFrame, log_col: str, part_col: str, text_col: str = "text", most: int = EVENT_FILES) -> DataFrame:
    """``sync_log`` of logs that are stored in parts: ``ord`` is an event's place in its whole log, parts in their order, nulls first.

    A part is parsed in one task, a log is not; only the parts' lengths meet by log.  A log has a part once; its own column
    is left out, as events name their machine.
    """
    n = F.coalesce(F.size(F.from_json(text_col, "events array<string>")["events"]), F.lit(0)).cast("bigint")
    earlier = Window.partitionBy("_log").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lengths = texts.select(F.col(log_col).alias("_log"), F.col(part_col).alias("_part"), F.greatest(n, F.lit(0)).alias("n"))
    starts = lengths.select("_log", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    placed = texts.join(starts, F.col(log_col).eqNullSafe(F.col("_log")) & F.col(part_col).eqNullSafe(F.col("_part"))).drop("_log", "_part")
    kept = placed.withColumnsRenamed({c: f"_{c}" for c in (log_col, part_col)})
    return sync_log(kept, text_col, most).withColumn("ord", F.col("ord") + F.col("_before")).drop("_before").withColumnRenamed(f"_{part_col}", part_col).drop(f"_{log_col}")


def events(lines: DataFrame, text_col: str = "text", most: int = EVENT_FILES) -> DataFrame:
    """A row for each message with an event; others, and those that lack a user, machine or time, are left out."""
    e = lines.select(*[c for c in lines.columns if c != text_col], F.from_json(text_col, EVENT).alias("e")).where("e.user is not null and e.machine is not null and e.timestamp is not null")
    return e.select(*[c for c in lines.columns if c != text_col], *_event("e", most))


def appended(log: DataFrame, new: DataFrame, most: int = LOG_EVENTS) -> DataFrame:
    """A log with new events behind the old ones, of which the last ``most`` by ``ord`` stay; ``ord`` counts on."""
    last = log.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    moved = new.join(F.broadcast(last), how="cross").withColumn("ord", F.col("ord") + F.col("last") + 1).select(*log.columns)
    return log.unionByName(moved).orderBy(F.desc("ord")).limit(most)


def inbox(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """(timestamp, title, message) and the event's fields of an inbox; one bad line empties it."""
    parsed = lines.where(F.trim(text_col) != "").select(F.from_json(text_col, f"timestamp string, title string, message string, {EVENT.replace('timestamp string, ', '')}").alias("e"), F.from_json(text_col, "map<string,string>").isNull().alias("bad"))
    bad = parsed.agg(F.coalesce(F.bool_or("bad"), F.lit(False)).alias("any_bad"))
    return parsed.join(F.broadcast(bad), how="cross").where("not any_bad").select("e.*")


def inbox_lines(rows: DataFrame) -> DataFrame:
    """Rows as lines of an inbox, to be appended."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


ENVELOPE = "path string, local_text string, remote_text string, base_text string, local_hash string, remote_hash string, base_hash string, created_at string, project_path string, backend string, unified_diff string, version int"


def envelopes(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Conflict envelopes of version 1 that have a path and both texts; others are skipped."""
    return texts.select(F.from_json(text_col, ENVELOPE).alias("e")).where("e.version = 1 and e.path is not null and e.local_text is not null and e.remote_text is not null").select("e.*")


def make_envelopes(conflicts: DataFrame, project: str, created_at: str) -> DataFrame:
    """Envelopes of (rel_path, local_text, remote_text, base_text, base_hash, backend), hashes of the texts' UTF-8 and the diff with them."""
    from driftwell.functions.text import unified_diff

    return conflicts.select(
        F.translate("rel_path", "\\", "/").alias("path"), "local_text", "remote_text", "base_text", F.sha2("local_text", 256).alias("local_hash"), F.sha2("remote_text", 256).alias("remote_hash"),
        "base_hash", F.lit(created_at).alias("created_at"), F.lit(project).alias("project_path"), "backend", unified_diff(F.col("remote_text"), F.col("local_text"), F.col("rel_path")).alias("unified_diff"), F.lit(1).alias("version"),
    )


def snapshot_catalogue(metas: DataFrame, manifests: DataFrame, text_col: str = "text") -> DataFrame:
    """All snapshots: folders of copies (``metas``: timestamp and the text of their notes) and lists of blobs (``manifests``).

    Notes that cannot be read give defaults, the snapshot stays.  One time may stand for a snapshot of each format.
    """
    note = "timestamp string, triggered_by string, action string, files_changed array<string>, total_files bigint, tag string, message string"

    def rows(df: DataFrame, kind: str) -> DataFrame:
        e = df.select("timestamp", F.from_json(text_col, note).alias("e"))
        return e.select(
            "timestamp", F.lit(kind).alias("format"), F.coalesce("e.triggered_by", F.lit("")).alias("triggered_by"), F.coalesce("e.action", F.lit("")).alias("action"),
            F.coalesce("e.files_changed", F.array().cast("array<string>")).alias("files_changed"), F.coalesce("e.total_files", F.lit(0)).alias("total_files"), F.nullif("e.tag", F.lit("")).alias("tag"), "e.message",
        )

    return rows(metas, "full").unionByName(rows(manifests, "blobs"))


def snapshot_files(manifests: DataFrame, text_col: str = "text") -> DataFrame:
    """(timestamp, path, hash) of the files that lists of blobs name."""
    return manifests.select("timestamp", F.explode(F.from_json(text_col, "files map<string,string>")["files"]).alias("path", "hash"))


def full_files(listing: DataFrame, meta: str = "_snapshot_meta.json") -> DataFrame:
    """(timestamp, path, id, size) of a listing of folders of copies, without the file of notes."""
    return listing.where(F.col("path") != meta).select("timestamp", "path", "id", F.coalesce("size", F.lit(0)).alias("size"))


def envelope_of_result(command: str, result: Column) -> Column:
    """A command's result as the JSON text others read: version, command, result."""
    return F.to_json(F.struct(F.lit(1).alias("version"), F.lit(command).alias("command"), result.alias("result")), {"ignoreNullFields": "false"})
