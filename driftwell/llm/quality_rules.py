"""Quality rules whose cut-offs are certified on labelled documents.

A joint rule rejects a document when any measure of its text lies above its cut-off.  Joint rules go from lax to strict
in ``PLACES`` steps, all measures at once, so each rejects all that the one before does.  For each stratum (a language by
default) they are tested in that order: the labelled good documents must prove, by the exact binomial tail, that the
chance to reject a good one is at most ``max_rejected``.  The first that fails ends the stratum's tests.  As the
order is fixed beforehand, the error level is divided by the number of strata only, and the statement holds for all
proved rules at once; of these a stratum has the laxest that rejects as many labelled bad documents as any (the strictest
where no bad ones are labelled).  A stratum whose labels prove nothing has no rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import takewhile
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import lighten, pieces
from .shared import written

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted"]
_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: SQL of each measure over the statistics, and its grid of cut-offs from strict to lax.
MEASURES = {
    "symbols": ("n_symbols / n_words", [0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0, 2.0]),
    "repeats": ("n_repeat_words / n_words", [0.05, 0.08, 0.1, 0.12, 0.15, 0.2]),
    "same_lines": ("n_dup_lines / n_lines", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8]),
    "shouted": ("n_shouted / n_words", [0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9]),
    "long_words": ("word_chars / n_words", [8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0]),
    "short_words": ("-word_chars / n_words", [-4.0, -3.5, -3.0, -2.5, -2.0, -1.5]),
}
#: Strata up to which the rules (a name and a number each) are broadcast.
BROADCAST_STRATA = 100_000
PLACES = max(len(grid) for _, grid in MEASURES.values())


def joint_rule(place: int) -> dict[str, float]:
    """The cut-offs of all measures at a place from 0 (each grid's laxest) to ``PLACES`` - 1 (each grid's strictest)."""
    return {m: grid[len(grid) - 1 - place * (len(grid) - 1) // (PLACES - 1)] for m, (_, grid) in MEASURES.items()}


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of ``STATS``; all 0 for a null or a text without words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(STATS)
    lines = [line for line in text.split("\n") if line.strip(_WHITE)]
    repeated = 0
    if n > 5:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        key = h[: n - 4].copy()
        for i in range(1, 5):
            key = (key ^ key >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + h[i : n - 4 + i]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if same.any():
            twice = np.zeros(len(key) + 1, bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            at = np.flatnonzero(twice)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    return (
        n, len(text) - sum(map(text.count, _WHITE)), sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)), repeated, len(lines), sum(map(bytes.isupper, words)),
    )


def with_stats(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of each whole text; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in pieces(batches):
            columns = list(zip(*map(text_stats, b.column(b.num_columns - 1).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, pa.int64()) for c in columns]], [*b.schema.names[:-1], *STATS])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} bigint" for c in STATS]
    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, ", ".join(kinds))


def base_failed():
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), to double precision: the sum of its terms from k down."""
    if k >= n:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p <= 0)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    for j in range(k, -1, -1):
        total += term
        if term < total * 1e-17:
            break
        term *= j * (1 - p) / ((n - j + 1) * p) if j else 0
    return min(1.0, total)


def _stratum(name: str):
    return F.col(name).cast("string").alias("stratum")


def _above(cuts: dict[str, float]):
    return reduce(or_, [F.coalesce(F.expr(MEASURES[m][0]) > c, F.lit(False)) for m, c in cuts.items()])


def calibrate(
    stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", stratum_col: str = "lang",
    key_col: str = "_key", max_rejected: float = 0.04, error: float = 0.05,
) -> DataFrame:
    """(stratum, place, strata): certified joint rules from all labelled documents (good 1, bad 0; with both labels good) that the base rule keeps.

    Copies are no independent trials, so of a stratum's documents with one text (one ``key_col``) one counts, good if any
    of them is.  Every stratum with a good document is tested, and the level is divided by their number (``strata``); a
    stratum without a row has no rule.  Counts and rules are tables of a row for each stratum, and tails are computed where
    the counts are.  Null labels and ids are left out; a null stratum is one of its own.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg((F.max(label_col) == 1).alias("_good"))
    rows = stats.where(~base_failed()).join(marks, id_col).groupBy(_stratum(stratum_col), F.col(key_col)).agg(
        F.max("_good").alias("_good"), *[F.max(c).alias(c) for c in STATS]
    )
    found = written(rows.groupBy("stratum").agg(
        F.count_if("_good").alias("n"),
        *[F.count_if(F.col("_good") & _above(joint_rule(k))).alias(f"good_{k}") for k in range(PLACES)],
        *[F.count_if(~F.col("_good") & _above(joint_rule(k))).alias(f"bad_{k}") for k in range(PLACES)],
        F.count_if(~F.col("_good")).alias("bad"),
    ).where("n > 0"))
    strata = found.count()
    level = error / max(1, strata)

    def certify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                proved = list(takewhile(lambda k, r=r: tail(r[f"good_{k}"], r["n"], max_rejected) <= level, range(PLACES)))
                if proved:
                    out.append((r["stratum"], max(proved, key=lambda k, r=r: (r[f"bad_{k}"], -k)) if r["bad"] else proved[-1], strata))
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["stratum", "place", "strata"])

    rules = found.mapInArrow(certify, "stratum string, place int, strata bigint")
    return F.broadcast(rules) if strata <= BROADCAST_STRATA else rules


def judged(stats: DataFrame, rules: DataFrame, stratum_col: str) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``: false where the base rule fails, else true unless a measure lies above its stratum's cut-off."""
    of = stats.join(rules.select(F.col("stratum").alias("_stratum"), F.col("place").alias("_place")), F.col(stratum_col).cast("string").eqNullSafe(F.col("_stratum")), "left")
    hit = reduce(lambda out, k: out.when(F.col("_place") == k, _above(joint_rule(k))), range(PLACES), F.when(F.lit(False), False))
    return of.select(*stats.columns, base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(hit, F.lit(False))).alias("kept"))


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **how) -> DataFrame:
    """(id, stratum, statistics, base_failed, kept) of every row.

    A null text has no words and fails the base rule.  Repeated rows and rows with a null id are judged each by itself.
    Other columns are not read, so their names cannot clash.  An empty table gives no rows.
    """
    keyed = df.select(id_col, stratum_col, F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    stats = written(with_stats(keyed, [id_col, stratum_col, "_key"], "_text"))
    rules = calibrate(stats, labels, id_col, stratum_col=stratum_col, **how)
    return judged(stats.drop("_key"), rules, stratum_col)


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **how) -> DataFrame:
    """The rows of ``df`` that the rules keep, unchanged.

    Each text is measured once: rows are written with their statistics, of which certifying reads those columns alone.
    """
    columns = df.columns
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"),
        F.xxhash64(text_col).alias("_key"), _stats_udf()(F.col(text_col)).alias("stats"),
    )
    measured = written(rows)
    rules = calibrate(measured.select("id", "stratum", "_key", "stats.*"), labels.withColumnRenamed(id_col, "id"), "id", stratum_col="stratum", **how)
    kept = judged(measured.select("row", "stratum", "stats.*"), rules, "stratum").where("kept")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def _stats_udf():
    kind = pa.struct([(c, pa.int64()) for c in STATS])

    def run(texts: pa.Array) -> pa.Array:
        rows = [text_stats(t) for i in range(0, len(texts), 256) for t in texts.slice(i, 256).to_pylist()]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(STATS), fields=list(kind))

    return F.arrow_udf(run, "struct<" + ",".join(f"{c}:bigint" for c in STATS) + ">")
