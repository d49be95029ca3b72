"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def _star(arcs: DataFrame, keep: str) -> DataFrame:
    """Hangs each ``v`` of the arcs (u, v) that ``keep`` holds of on the smallest of u's whole neighbourhood."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.where(keep).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that can be reached from it.

    Each round hangs every larger neighbour on a node's smallest one, then every smaller; both are joins on the
    node with a pre-aggregated minimum, so a node with very many links stays one row on one side and is split by
    adaptive execution on the other.  Rounds end when a round changes nothing; their number grows with the
    logarithm of the longest chain.  Edges with a null end and loops are passed over; no edges give no rows.
    """
    ab = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    now = written(ab.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    before = None
    while before != (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()):
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = _star(both, "v > u").where("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _star(down, "v < u").union(
            down.groupBy("u").agg(F.min("v").alias("b"))
        )
        after = written(small.where("a <> b").distinct())
        drop(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
