"""Activity log: statistics, presence, windows and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import rules


def stats(log: DataFrame, by: str, top: int | None = None, backend: str = "") -> DataFrame:
    """(key, events, files, conflicts) by user, machine, action, day or backend.

    Rows whose key is null or empty are left out; null file names and a null count of conflicts count as none.  All events
    are of one backend, ``unknown`` where none is named.  With ``top`` only the newest days, or the keys with most events,
    ties by key; 0 gives no rows.
    """
    key = F.lit(backend or "unknown") if by == "backend" else F.date_format("ts", "yyyy-MM-dd") if by == "day" else F.col(by)
    n = F.coalesce(F.size(F.filter("files", lambda x: x.isNotNull())), F.lit(0))
    out = log.select(key.alias("key"), F.greatest(n, F.lit(0)).alias("n"), F.coalesce("conflicts", F.lit(0)).alias("conflicts")).where("key is not null and key <> ''").groupBy("key").agg(
        F.count("*").alias("events"), F.sum("n").alias("files"), F.sum("conflicts").alias("conflicts")
    )
    order = [F.desc("key")] if by == "day" else [F.desc("events"), F.col("key")]
    return out if top is None else out.orderBy(*order).limit(max(0, top))


def totals(rows: DataFrame) -> DataFrame:
    """One row (events, files, conflicts) of all of ``stats``' rows, so before any ``top``."""
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events", "files", "conflicts")])


def conflict_count(entries: Column) -> Column:
    """How many conflicts an event settled by itself; null is none."""
    return F.greatest(F.coalesce(F.size(entries), F.lit(0)), F.lit(0)).cast("bigint")


def between(log: DataFrame, since: str, until: str) -> DataFrame:
    """The events from ``since`` to ``until``, both included; a null time is in no window."""
    return log.where((F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(until).cast("timestamp_ntz")))


def active(log: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """The events of the last hours before ``now``; later ones too."""
    return log.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours)))


def others(log: DataFrame, machine: str, user: str | None = None) -> DataFrame:
    """The events of others: of all other machines, or, with a user, of all but this user on this machine.  Null names are others."""
    mine = F.col("machine").eqNullSafe(F.lit(machine))
    return log.where(~(mine if user is None else mine & F.col("user").eqNullSafe(F.lit(user))))


def well_formed(log: DataFrame) -> DataFrame:
    """The events that have a user, a machine and a readable time."""
    return log.where("user is not null and machine is not null and ts is not null")


def tail(log: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` events by place."""
    return log.orderBy(F.desc("ord")).limit(max(0, n))


def last_foreign_change(log: DataFrame, paths: DataFrame, machine: str) -> DataFrame:
    """(path, user, machine, ts) of the newest event by place of another machine that names a path (path, since), if it is later than ``since``.

    Times are compared as texts.  An older foreign event behind one that is too old is not looked for.
    """
    named = log.where(F.col("machine") != machine).select("ord", "user", "machine", "ts", F.explode(F.array_distinct("files")).alias("path"))
    newest = named.groupBy("path").agg(F.max(F.struct("ord", "user", "machine", "ts")).alias("e"))
    asked = paths.where("path is not null").join(newest, "path")
    return asked.where("coalesce(since, '') = '' or e.ts > since").select("path", "e.user", "e.machine", "e.ts")


def once(log: DataFrame) -> DataFrame:
    """The log with each event (time, user, machine, files) once, at its first place: an event may have been written twice."""
    key = ["ts", "user", "machine", "files"]
    columns = [c for c in log.columns if c not in [*key, "ord"]]
    return log.groupBy(*key).agg(F.min(F.struct("ord", *columns)).alias("e")).select("e.ord", *key, *[f"e.{c}" for c in columns])


def presence(log: DataFrame, recent: int = 5) -> DataFrame:
    """(user, machine, action, last_seen, recent_files): the newest event of each, and its newest distinct files."""
    newest = log.groupBy("user", "machine").agg(F.max_by("action", F.struct("ts", -F.col("ord"))).alias("action"), F.max("ts").alias("ts"))
    seen = log.select("user", "machine", "ts", "ord", F.posexplode("files").alias("pos", "file")).groupBy("user", "machine", "file").agg(
        F.max(F.struct("ts", -F.col("ord"), -F.col("pos"))).alias("at")
    )
    rank = F.row_number().over(Window.partitionBy("user", "machine").orderBy(F.desc("at")))
    few = seen.withColumn("rank", rank).where(F.col("rank") <= recent).groupBy("user", "machine").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "file"))), lambda x: x["file"]), "|").alias("recent_files")
    )
    return newest.join(few, ["user", "machine"], "left").select("user", "machine", "action", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "recent_files")


def after_cursor(log: DataFrame, **key: str) -> DataFrame:
    """Rows after the first one with the stored key; all rows where there is none (the log was rotated)."""
    same = F.lit(True)
    for name, value in key.items():
        same = same & (F.col(name) == value)
    first = log.where(same).agg(F.min("ord").alias("first"))  # one row
    return log.join(F.broadcast(first), how="cross").where("first is null or ord > first").drop("first")


#: The actions of a route that names none, and its paths.
ROUTE_ACTIONS, ROUTE_PATHS = ["push", "pull", "sync", "delete"], ["**/*"]


def routed(log: DataFrame, routes: list[tuple[str, list[str], list[str]]], keep: tuple[str, ...] = ()) -> DataFrame:
    """(ord, ``keep``, route, files): events each route (name, actions, shell patterns) takes, with the files it asks for.

    An event without files goes to every route of its action; one whose files all miss goes to none.  A route that names no
    actions or patterns has the usual ones.  Routes are configuration, a handful; one pass over the log makes a row for each
    that matches.
    """
    files = F.coalesce("files", F.array().cast("array<string>"))

    def take(name: str, actions: list[str], globs: list[str]):
        mine = F.filter(files, lambda x: rules.matches_any(x, globs or ROUTE_PATHS))
        return F.when(F.col("action").isin(actions or ROUTE_ACTIONS), F.struct(F.lit(name).alias("route"), mine.alias("files")))

    taken = F.array(*[take(*route) for route in routes])
    rows = log.select("ord", *keep, F.size(files).alias("_n"), F.explode(F.array_compact(taken)).alias("_r")).where("size(_r.files) > 0 or _n = 0")
    return rows.select("ord", *keep, "_r.route", "_r.files")


def routes_of(routes: list[dict] | None, legacy_url: str | None) -> list[dict]:
    """The routes of a provider: the list if there is one, else one for all actions and paths to the single address, else none."""
    if routes:
        return [{"url": r["webhook_url"], "on": r.get("on") or ROUTE_ACTIONS, "paths": r.get("paths") or ROUTE_PATHS} for r in routes]
    return [{"url": legacy_url, "on": ROUTE_ACTIONS, "paths": ROUTE_PATHS}] if legacy_url else []
