"""Approximate nearest neighbours under cosine: an NN-descent graph and greedy search on it.

Rows with equal vectors are one node, so copies cost nothing and their ties are exact.  The graph starts from a few dozen
nodes that stand beside each node in a few random orders of space, poor lists mostly.  Rounds of NN-descent improve them:
the neighbours of a node, forward and (a bounded sample) backward, are joined to it and compared with each other where one
of them is new, and each node keeps its best ``k``.  Rounds end when few lists still change.  A query walks the graph: the
unvisited neighbours of its best nodes so far are joined and scored until none of the best is unvisited.  Graph building
works on half-precision unit vectors; reported scores are computed in double precision from the original ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import whole_groups
from .shared import drop, partitions, written

_PAIRS = "a bigint, b bigint, sim float"
#: A node's neighbours, their similarities and whether they are new, packed; a node may have several such rows.
_LISTS = "a bigint, b binary, sim binary, new binary"


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that take part: no null, zero or non-finite vector, and of the commonest length."""
    vec = F.col("vec")
    ok = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        "id is not null and vec is not null and size(vec) > 0 "
        "and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    )
    length = ok.groupBy(F.size(vec).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return ok.where(F.size(vec) == (length[0].n if length else 0))


def _scaled(vec: pa.Array) -> np.ndarray:
    """Vectors by their largest components, so that squares neither overflow nor vanish."""
    x = vec.values.to_numpy(zero_copy_only=False)[vec.offsets[0].as_py() : vec.offsets[-1].as_py()].reshape(len(vec), -1)
    x = x * np.exp2(-np.frexp(np.abs(x).max(axis=1, keepdims=True))[1] // 2)  # in two steps, as 2**1074 is no double
    return x * np.exp2(-np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(vec: pa.Array) -> np.ndarray:
    x = _scaled(vec)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: pa.Array, y: pa.Array) -> np.ndarray:
    """The cosine of each pair of vectors in double precision; powers of two that vectors are scaled by change no digit of it."""
    x, y = _scaled(x), _scaled(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


def _packed(unit: np.ndarray) -> pa.Array:
    raw, size = unit.astype(np.float16).tobytes(), 2 * unit.shape[1]
    return pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())


def nodes_of(vectors: DataFrame, directions: int, seed: int = 11) -> DataFrame:
    """(node, vec, unit, lines): distinct vectors under the least of their ids, and their codes along random directions.

    A code packs the signs of 16 projections, so nodes with near codes lie in the same corners of space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit(b.column("vec"))
            planes = np.random.default_rng(seed).normal(size=(unit.shape[1], 16 * directions))
            bits = (unit @ planes > 0).reshape(len(unit), directions, 16)
            codes = (bits << np.arange(15, -1, -1)).sum(axis=2)
            lines = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * directions), pa.array(codes.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("vec"), _packed(unit), lines], ["node", "vec", "unit", "lines"])

    distinct = vectors.groupBy("vec").agg(F.min("id").alias("node"))
    return distinct.select("node", "vec").mapInArrow(run, "node bigint, vec array<double>, unit binary, lines array<bigint>")


def _top(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _combined(a: np.ndarray, b: np.ndarray, sim: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best arcs of each node, sorted by node; of an arc that comes twice the old one stays."""
    order = np.lexsort((new, b, a))
    a, b, sim, new = a[order], b[order], sim[order], new[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, sim, new = a[once], b[once], sim[once], new[once]
    order = np.lexsort((b, -sim, a))
    first = np.flatnonzero(np.diff(a, prepend=a[0] - 1)) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    order = order[rank < k]
    return a[order], b[order], sim[order], new[order]


def _lists(a: np.ndarray, b: np.ndarray, sim: np.ndarray, new: np.ndarray, k: int) -> pa.RecordBatch:
    """A row for each node with its ``k`` best arcs."""
    a, b, sim, new = _combined(a, b, sim, new, k)
    first = np.flatnonzero(np.diff(a, prepend=a[0] - 1)) if len(a) else np.zeros(0, np.int64)
    ends = np.append(first, len(a)).astype(np.int32)
    columns = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in (b, sim, new)]
    return pa.RecordBatch.from_arrays([pa.array(a[first]), *columns], ["a", "b", "sim", "new"])


def _flat(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    b, sim, new = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in (("b", np.int64), ("sim", np.float32), ("new", np.uint8)))
    sizes = np.array([len(x) for x in t["new"].to_pylist()], np.int64)
    return np.repeat(t["a"].to_numpy(), sizes), b, sim, new


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One row for each node, with its ``k`` best arcs from all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for t in whole_groups(batches, "a"):
            held.append(t)
            rows += t.num_rows
            if rows >= 20_000:
                yield _lists(*_flat(pa.concat_tables(held)), k)
                held, rows = [], 0
        if held:
            yield _lists(*_flat(pa.concat_tables(held)), k)

    return written(lists.repartition(partitions(lists.sparkSession), "a").sortWithinPartitions("a").mapInArrow(run, _LISTS))


def _arcs(lists: DataFrame) -> DataFrame:
    """(a, b, sim, new) of the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b, sim, new = _flat(x)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim), pa.array(new.astype(bool))], ["a", "b", "sim", "new"])

    return lists.mapInArrow(run, _PAIRS + ", new boolean")


def first_lists(nodes: DataFrame, k: int, block: int) -> DataFrame:
    """The best ``k`` of each node within blocks of ``block`` nodes that follow one another in an order of codes.

    Blocks of one order overlap by half, so no node stands at the edge of both of its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            n = min(k, len(ids) - 1)
            at = np.argpartition(-sim, n - 1, axis=1)[:, :n]
            i = np.repeat(np.arange(len(ids)), n)
            return _lists(ids[i], ids[at.ravel()], sim[i, at.ravel()], np.ones(len(i), np.uint8), k)

        ids, rows, of = np.zeros(0, np.int64), None, None
        for b in batches:
            direction = b.column("direction").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(direction)) + 1).tolist(), len(direction)] if len(direction) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if of is not None and of != direction[lo]:
                    if len(ids) > 1:
                        yield lists(ids, rows)
                    ids, rows = ids[:0], None
                of, part = direction[lo], b.slice(lo, hi - lo)
                x = _matrix(part.column("unit"))
                ids, rows = np.append(ids, part.column("node").to_numpy()), x if rows is None else np.concatenate([rows, x])
                while len(ids) >= 2 * block:
                    yield lists(ids[:block], rows[:block])
                    ids, rows = ids[block // 2 :], rows[block // 2 :]
        if len(ids) > 1:
            yield lists(ids, rows)

    keys = ["direction", "code", F.xxhash64("node")]
    tasks = min(partitions(nodes.sparkSession), 1 + nodes.count() // (8 * block))  # so few nodes stand at the edge of a task
    ranged = nodes.select("node", "unit", F.posexplode("lines").alias("direction", "code")).repartitionByRange(tasks, *keys)
    return ranged.sortWithinPartitions(*keys).select("node", "unit", "direction").mapInArrow(run, _LISTS)


def _descend(lists: DataFrame, nodes: DataFrame, k: int, sample: int) -> DataFrame:
    """One round: lists of the neighbours of neighbours that may enter a node's best ``k``."""
    arcs = _arcs(lists)
    back = arcs.select(F.col("b").alias("at"), F.col("a").alias("of"), "new")
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("new"), F.xxhash64("at", "of")))
    back = back.withColumn("rank", rank).where(F.col("rank") <= sample).drop("rank")
    both = arcs.select(F.col("a").alias("at"), F.col("b").alias("of"), "new").union(back)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sims = [np.frombuffer(s, np.float32) for s in x["sim"].to_pylist()]
            yield pa.RecordBatch.from_arrays([x["a"], pa.array([s.min() if len(s) >= k else -2.0 for s in sims], pa.float32())], ["of", "floor"])

    floor = lists.select("a", "sim").mapInArrow(floors, "of bigint, floor float")
    members = nodes.select(F.col("node").alias("of"), "unit").join(floor, "of", "left")
    joined = both.join(members, "of").select("at", "of", "new", "unit", F.coalesce("floor", F.lit(-2.0)).cast("float").alias("floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "at"):
            at, of, new, floor_, x = t["at"].to_numpy(), t["of"].to_numpy(), t["new"].to_numpy(), t["floor"].to_numpy(), _matrix(t["unit"])
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            a, b, s = [], [], []
            for lo, hi in zip(edges, edges[1:], strict=False):
                n, o = new[lo:hi], of[lo:hi]
                if hi - lo < 2 or not n.any():
                    continue
                sim = x[lo:hi] @ x[lo:hi].T
                i, j = np.nonzero((n[:, None] | n[None, :]) & (sim > floor_[lo:hi, None]) & (o[:, None] != o[None, :]))
                a.append(o[i])
                b.append(o[j])
                s.append(sim[i, j])
            if a:
                yield _lists(*map(np.concatenate, (a, b, s)), np.ones(sum(map(len, a)), np.uint8), k)

    n = partitions(lists.sparkSession)
    return joined.repartition(n, "at").sortWithinPartitions("at").mapInArrow(run, _LISTS)


def build(nodes: DataFrame, k: int = 50, sample: int = 36, rounds: int | None = None, block: int = 64, still: float = 0.02) -> DataFrame:
    """(a, b, sim, new): the best ``k`` neighbours found of each node.

    Rounds of NN-descent go on until one brings new arcs to at most the share ``still`` of all arcs; ``rounds`` ends them
    earlier.
    """

    def old(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b, sim, new = _flat(x)
            if len(a):
                yield _lists(a, b, sim, np.zeros_like(new), k)

    lists, done = _merged(first_lists(nodes, k, block), k), 0
    while rounds is None or done < rounds:
        before, lists = lists, _merged(lists.mapInArrow(old, _LISTS).union(_descend(lists, nodes, k, sample)), k)
        drop(before)
        done += 1
        arcs, new = _arcs(lists).agg(F.count("*"), F.count_if("new")).first()
        if new <= still * arcs:
            break
    return _arcs(lists)


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, width: int = 48, sample: int = 12) -> DataFrame:
    """(query, node): the ``width`` best nodes found for each (query, unit, start), by greedy walks from ``start``.

    A walk ends when its best ``width`` nodes are all visited.
    """
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    ways = written(graph.select("a", "b").union(_top(back, sample).select("a", "b")).distinct())
    units = nodes.select(F.col("node").alias("b"), "unit")
    asked = queries.select(F.col("query").alias("a"), F.col("unit").alias("asked"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                sim = np.einsum("ij,ij->i", _matrix(x.column("asked")), _matrix(x.column("unit")))
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(sim)], ["a", "b", "sim"])

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(units, "b").join(asked, "a").select("a", "b", "asked", "unit").mapInArrow(score, _PAIRS)

    starts = queries.select(F.col("query").alias("a"), F.col("start").alias("b")).distinct()
    best = written(_top(scored(starts), width).withColumn("visited", F.lit(False)))
    while not (todo := best.where("not visited").select("a", F.col("b").alias("via"))).isEmpty():
        near = todo.join(ways.withColumnRenamed("a", "via"), "via").select("a", "b").distinct()
        new = scored(near.join(best.select("a", "b"), ["a", "b"], "left_anti")).withColumn("visited", F.lit(False))
        # a node seen before and dropped from the best scores as before and drops again
        before, best = best, written(_top(best.withColumn("visited", F.lit(True)).union(new), width))
        drop(before)
    return best.select(F.col("a").alias("query"), F.col("b").alias("node"))


def nearest(
    df: DataFrame, queries: str = "id % 50 = 0", top: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", **how
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest other rows of each row that ``queries`` (SQL over ``id``) holds of.

    Nearest first, ties to the smaller id; fewer where there are fewer rows.  Rows with a null id or a vector that is null,
    zero or not finite, or of another length than most, take no part.  Rows with equal vectors have equal scores, and
    all of them are candidates.  Rows that repeat an id are candidates each, but a query is never its own neighbour.
    Other columns are not read.  No queries or an empty table give no rows.
    """
    vectors = written(usable(df, id_col, vec_col))
    nodes = written(nodes_of(vectors, how.pop("directions", 2)))
    graph = build(nodes, **how)
    member = vectors.join(nodes.select("vec", "node"), "vec").select("id", "node")
    asking = written(member.where(queries).distinct())
    asked = asking.select("node").distinct().join(nodes, "node").select(F.col("node").alias("query"), "unit", F.col("node").alias("start"))
    found = search(graph, nodes, asked)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = cosines(b.column("x"), b.column("y"))
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array(score)], ["query", "node", "score"])

    vec = nodes.select("node", F.col("vec").alias("y"))
    pairs = found.join(vec, "node").join(nodes.select(F.col("node").alias("query"), F.col("vec").alias("x")), "query").select("query", "node", "x", "y")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    classes = pairs.mapInArrow(exact, "query bigint, node bigint, score double").withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1).drop("r")
    # of a class only its smallest ids can be among the nearest
    few = member.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= top + 1).select("node", F.col("id").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        asking.select(F.col("id").alias("query_id"), F.col("node").alias("query")).join(classes, "query").join(few, "node")
        .where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
    )
