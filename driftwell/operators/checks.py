"""Integrity and health: phases of a verification, and the worst of a list of checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions import rules

COUNTERS = ["checked", "verified", "drift", "missing", "corrupted"]


def manifest_findings(manifest: DataFrame, remotes: DataFrame, live: DataFrame, backends: list[str]) -> DataFrame:
    """(backend, rel_path, finding, expected, actual) for each path and backend: verified, drift or missing.

    What a mirror does not have yet, and what is not in order anyway, counts as verified.  ``live`` holds (backend, rel_path,
    hash) as the backends say now; an expected hash that is empty takes any.  Null paths take no part.
    """
    targets = manifest.where("rel_path is not null").select("rel_path", F.explode(F.array(*map(F.lit, backends))).alias("backend"))
    known = remotes.select("rel_path", "backend", "state", F.col("remote_hash").alias("expected"), F.lit(True).alias("known"))
    seen = targets.join(known, ["rel_path", "backend"], "left").join(live.select("rel_path", "backend", F.col("hash").alias("actual")), ["rel_path", "backend"], "left")
    asked = F.col("known").isNotNull() & (F.col("state") == "ok")
    finding = F.when(~asked, "verified").when(F.col("actual").isNull(), "missing").when((F.coalesce("expected", F.lit("")) != "") & (F.col("expected") != F.col("actual")), "drift").otherwise("verified")
    return seen.select("backend", "rel_path", finding.alias("finding"), "expected", "actual")


def blob_findings(blobs: DataFrame) -> DataFrame:
    """(backend, rel_path, finding, expected, actual) of stored blobs (backend, name, content): corrupted where the name is no digest or not that of the content, missing without content."""
    actual = F.sha2("content", 256)
    finding = F.when(~rules.is_sha256(F.col("name")), "corrupted").when(F.col("content").isNull(), "missing").when(actual != F.col("name"), "corrupted").otherwise("verified")
    return blobs.select("backend", F.col("name").alias("rel_path"), finding.alias("finding"), F.col("name").alias("expected"), actual.alias("actual"))


def cache_findings(cached: DataFrame) -> DataFrame:
    """``blob_findings`` of a local cache (name, content): what cannot be read is corrupted, not missing."""
    return blob_findings(cached.withColumn("backend", F.lit("cache"))).withColumn("finding", F.when(F.col("finding") == "missing", "corrupted").otherwise(F.col("finding")))


def phase_counts(findings: DataFrame, phase: str) -> DataFrame:
    """One row (phase, checked, verified, drift, missing, corrupted)."""
    return findings.agg(F.count("*").alias("checked"), *[F.count_if(F.col("finding") == c).alias(c) for c in COUNTERS[1:]]).select(F.lit(phase).alias("phase"), *COUNTERS)


def verify(phases: dict[str, DataFrame]) -> DataFrame:
    """The counts of all phases, one row each, and whether a phase has anything to tell."""
    rows = reduce(DataFrame.unionByName, [phase_counts(df, name) for name, df in phases.items()])
    return rows.withColumn("findings", F.col("drift") + F.col("missing") + F.col("corrupted") > 0)


def health(checks: DataFrame) -> DataFrame:
    """One row (status): the worst of the checks' statuses; unsupported ones do not count, none at all is ok."""
    rank = F.expr("case status when 'fail' then 2 when 'warn' then 1 when 'ok' then 0 end")
    return checks.agg(F.coalesce(F.max(rank), F.lit(0)).alias("r")).select(F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), F.col("r") + 1).alias("status"))


def report(checks: list[DataFrame]) -> DataFrame:
    """(name, status, detail): all checks' rows of (name, status, detail), and one named ``overall`` with the worst status and how many checks there were."""
    rows = reduce(DataFrame.unionAll, [c.select("name", "status", "detail") for c in checks])
    rank = F.expr("case status when 'fail' then 2 when 'warn' then 1 when 'ok' then 0 end")
    worst = rows.agg(F.coalesce(F.max(rank), F.lit(0)).alias("r"), F.count("*").alias("n"))
    overall = worst.select(F.lit("overall").alias("name"), F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), F.col("r") + 1).alias("status"), F.concat(F.col("n").cast("string"), F.lit(" checks")).alias("detail"))
    return rows.unionAll(overall)


#: Hours since the last sync beyond which a project is warned of, and failed.
WARN_HOURS, FAIL_HOURS = 24, 72


def last_sync_age(log: DataFrame, now: Column, time: str = "ts", place: str = "ord") -> DataFrame:
    """One row (name, status): by the age of the last event by place; a time that is null (not readable) warns, an empty log is ok."""
    last = log.agg(F.count("*").alias("n"), F.max(F.struct(F.col(place).alias("p"), F.col(time).alias("t")))["t"].alias("t"))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))) / 3.6e9
    status = F.when(F.col("n") == 0, "ok").when(F.col("t").isNull(), "warn").when(hours > FAIL_HOURS, "fail").when(hours > WARN_HOURS, "warn").otherwise("ok")
    return last.select(F.lit("last_sync_age").alias("name"), status.alias("status"))


def summary(states: DataFrame) -> DataFrame:
    """One row of an unattended run: how many files in sync, to upload, to download, in conflict, deleted here."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return states.agg(
        n("in_sync").alias("in_sync"), n("local_ahead", "new_local").alias("to_push"), n("remote_ahead", "new_remote").alias("to_pull"), n("conflict").alias("conflicts"),
        n("deleted_local").alias("deleted"), F.count("*").alias("total"),
    )
