"""Ignore rules by the thousands: candidates by a join on letters, the last rule that matches by rank.

A path can only match a rule whose literal letters it holds.  Each rule is filed under one piece of its literals, the
longest and rarest; a path asks for its own pieces of the lengths in use and meets only rules filed under them, and the
rules' regexes are tried on those.  Rules without any literal are filed under the empty piece, which every path asks for.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions import rules

#: Lengths of pieces; a rule's pieces have the largest length that its longest literal holds.
_LENGTHS = (8, 4, 2, 1)
#: The rules are broadcast while their texts take no more bytes than this, else both sides are shuffled by the piece.
BROADCAST_BYTES = 16 << 20


#: Rules, or paths, a task gets where they are parsed, or joined by the piece.
ROWS_A_TASK = 25_000
#: Buckets in which pieces are counted: how common a piece is only decides where a rule is filed, so buckets may be shared.
_BUCKETS = 1 << 18


def _tasks(*counts: int) -> int:
    return max(1, *(-(-n // ROWS_A_TASK) for n in counts))


def _parsed(b: pd.DataFrame) -> Iterator[tuple]:
    """(ord, (negated, folder, rx), pieces) of a batch's rules."""
    for ord_, line in zip(b["ord"], b["line"]):
        rule = rules.ignore_regex(line) if line is not None else None
        if rule:
            runs = rules.literal_runs(line)
            n = next((n for n in _LENGTHS if n <= max(map(len, runs), default=0)), 0)
            yield ord_, rule, sorted({r[i : i + n] for r in runs for i in range(len(r) - n + 1)}) if n else [""]


def _bucket(piece: str) -> int:
    return zlib.crc32(piece.encode("utf-8", "surrogatepass")) % _BUCKETS


def compiled(lines: DataFrame, ord_col: str = "ord", line_col: str = "line") -> DataFrame:
    """(ord, negated, folder, rx, piece) of rule lines (ord, line): each under one piece.  Blanks, comments and over-long lines are no rules.

    The pieces of all rules are counted first, in buckets whose number is fixed; a rule then picks its rarest by itself, so
    rules are never gathered by a piece that many of them hold.
    """
    rows = lines.select(F.col(ord_col).cast("bigint").alias("ord"), F.col(line_col).alias("line"))
    rows = rows.repartition(_tasks(rows.count()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter(_bucket(p) for b in batches for *_, pieces in _parsed(b) for p in pieces)
        yield pd.DataFrame({"bucket": list(n.keys()), "n": list(n.values())}, dtype="int64")

    found = rows.mapInPandas(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most _BUCKETS rows
    common = np.zeros(_BUCKETS, np.int64)
    if found:
        common[[r["bucket"] for r in found]] = [r["n"] for r in found]
    shared = lines.sparkSession.sparkContext.broadcast(common)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = shared.value
        for b in batches:
            out = [(ord_, *rule, min(pieces, key=lambda p: (n[_bucket(p)], p))) for ord_, rule, pieces in _parsed(b)]
            yield pd.DataFrame(out, columns=["ord", "negated", "folder", "rx", "piece"])

    return rows.mapInPandas(file, "ord bigint, negated boolean, folder boolean, rx string, piece string")


def many_ignored(paths: DataFrame, lines: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """(path, ignored) of each distinct path that is not null: what ``rules.ignored`` says, with rules as a table (ord, line).

    The work grows with the paths' lengths and the rules that share a piece with a path, not with paths times rules.
    """
    found = compiled(lines)
    about = found.agg(F.count("*").alias("rules"), F.coalesce(F.sum(F.length("rx") + 40), F.lit(0)).alias("bytes"), F.collect_set(F.length("piece")).alias("lengths")).first()  # at most five lengths
    known = paths.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path")).distinct()
    bare = F.ltrim("path", F.lit("/"))
    # a pattern's end may stand before a line's end, so such a path is also asked about without it
    whole = F.concat(F.lit("/"), bare, F.lit("/"), F.when(bare.endswith("\n"), F.concat(F.lit("/"), F.rtrim(bare, F.lit("\n")), F.lit("/"))).otherwise(""))
    lengths = sorted(about["lengths"])
    cut = [F.expr(f"if(length(whole) >= {n}, transform(sequence(1, length(whole) - {n} + 1), i -> substring(whole, i, {n})), array())" if n else "array('')") for n in lengths]
    asked = known.withColumn("whole", whole)
    grams = asked.select("path", bare.alias("bare"), F.explode(F.array_distinct(F.concat(*cut))).alias("piece")) if cut else asked.limit(0).select("path", bare.alias("bare"), F.lit("").alias("piece"))
    hit = F.expr("case when folder then regexp_extract(bare, rx, 1) <> '' else bare rlike rx end")
    if about["bytes"] <= BROADCAST_BYTES:
        asked_of = grams.join(F.broadcast(found), "piece")
    else:
        n = _tasks(about["rules"], paths.count())
        asked_of = grams.repartition(n, "piece").join(found.repartition(n, "piece"), "piece")
    last = asked_of.where(hit).groupBy("path").agg(F.max_by("negated", "ord").alias("negated"))
    return known.join(last, "path", "left").select(F.col("path").alias(path_col), F.coalesce(~F.col("negated"), F.lit(False)).alias("ignored"))
