"""SimHash near-duplicates with BK-trees over shards of fingerprints.

A fingerprint's 64 bits are four blocks of 16; two fingerprints that differ in at most three bits agree on a
whole block, and the other 48 bits, cut in four again, agree on a whole part of 12.  So every pair within the
radius meets in at least one of 16 shards named by (block, its bits, part, its bits).  Each shard has a BK-tree
whose children are keyed by their Hamming distance to the parent; a lookup follows only edges within the radius.

The trees stay with their shards.  Broadcasting them would send every fingerprint to every executor, which grows
with the corpus, and a tree over all of it prunes little at 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import lighten, pieces, whole_groups
from .components import connected_components
from .shared import drop, partitions, written

RADIUS = 3
_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of all word shingles in their order; of the whole sequence if it is shorter; none for no words or a null."""
    words = (text or "").encode().translate(_SMALL).split()
    if len(words) <= shingle:
        return np.array([_hash(b" ".join(words))] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, line = [0, *ends[:-1].tolist()], b" ".join(words)
    return np.array([_hash(line[a:b]) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=False)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 for none."""
    counts = np.zeros(64, np.uint32)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the bits of the XXH64 of all word shingles; 0 for a text without words or a null."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


class BKTree:
    """Integers under Hamming distance; a node is [value, item, children by distance]."""

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = [value, item, {}]
            return
        node = self.root
        while (d := (node[0] ^ value).bit_count()) in node[2]:
            node = node[2][d]
        node[2][d] = [value, item, {}]

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The items at distance ``radius`` or less."""
        todo = [self.root] if self.root else []
        while todo:
            v, item, below = todo.pop()
            d = (v ^ value).bit_count()
            if d <= radius:
                yield item
            todo += [child for k, child in below.items() if d - radius <= k <= d + radius]


def _forest(values: list[int], radius: int, alike: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the values within the radius of each other (and ``alike``), as pairs of indexes.

    Each node of the BK-tree knows whether all that is below it was linked when it came; a lookup passes such a subtree by
    once it is linked with it, so a large group of near values costs far less than all its pairs.
    """
    up, root = list(range(len(values))), None

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, v in enumerate(values):
        todo = [root] if root else []
        while todo:
            at, below, one = todo.pop()
            if one[0] >= 0 and top(one[0]) == top(i):
                continue
            d = (values[at] ^ v).bit_count()
            if d <= radius and (a := top(i)) != (b := top(at)) and (alike is None or alike(i, at)):
                up[max(a, b)] = min(a, b)
                yield i, at
            todo += [child for k, child in below.items() if d - radius <= k <= d + radius]
        node, new = root, (i, {}, [i])
        if node is None:
            root = new
            continue
        while True:
            if node[2][0] >= 0 and top(node[2][0]) != top(i):
                node[2][0] = -1  # below it there are values of several components
            d = (values[node[0]] ^ v).bit_count()
            if d not in node[1]:
                node[1][d] = new
                break
            node = node[1][d]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the ``node`` of different ``fp``, enough of them to join all that are within the radius.

    ``radius`` is 3 at most.  Within a shard links come from a spanning forest, never as all pairs.
    """
    if radius > 3:
        raise ValueError("shards are exact up to three differing bits")
    shards = []
    for block in range(4):
        rest = [p for b in range(4) if b != block for p in range(16 * b, 16 * b + 16)]
        for part in range(4):
            bits = [*range(16 * block, 16 * block + 16), *rest[12 * part : 12 * part + 12]]
            mask = sum(1 << b for b in bits)
            shards.append((4 * block + part, mask - (1 << 64) if mask >> 63 else mask))
    spread = nodes.select("fp", "node", F.explode(F.array(*[
        F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask))) for k, mask in shards
    ])).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "shard"):
            shard = t["shard"].to_numpy()
            cut = np.flatnonzero(np.diff(shard)) + 1
            edges = np.concatenate([[0], cut, [len(shard)]])
            large = np.flatnonzero(np.diff(edges) > 1)
            if not len(large):
                continue
            fp, node, a, b = t["fp"].to_numpy().view(np.uint64), t["node"], [], []
            for g in large:
                lo, hi = int(edges[g]), int(edges[g + 1])
                for i, j in _forest(fp[lo:hi].tolist(), radius):
                    a.append(lo + i)
                    b.append(lo + j)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(x, pa.int64())).combine_chunks() for x in (a, b)], ["a", "b"])

    kind = nodes.schema["node"].dataType.simpleString()
    spark = nodes.sparkSession
    return (
        spread.repartition(partitions(spark), "shard").sortWithinPartitions("shard")
        .mapInArrow(run, f"a {kind}, b {kind}").distinct()
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id that links lead to.

    Rows with equal fingerprints are one node, so any number of copies costs one row.  Empty and null texts have
    fingerprint 0 and link like others.  Rows with one id are one document.  A row with a null id links nothing and
    has the component of the rows with its fingerprint (null if there are none).  An empty table gives no rows.
    Columns other than the id and the text are not read.
    """
    prints = written(fingerprints(df, id_col, text_col, shingle))
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("node")))
    roots = connected_components(links(nodes.where("node is not null"), radius).union(
        # fingerprints of one id are one document
        prints.where("id is not null").join(nodes, "fp").where("id <> node").select("id", "node")
        .join(nodes.select(F.col("node").alias("id")), "id", "left_semi").distinct()
    ))
    parts = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    return prints.join(parts, "fp").select("id", "fp", "component")


#: random orders of all shingles; a text's first in each names a shard
_ORDERS = 10
#: two texts of similarity 0.8 differ in 10 of 64 bits on average, short ones in 12; strangers in 32
_WIDE = 22
_FACTORS = [np.uint64(_hash(b"order %d" % k) | 1) for k in range(_ORDERS)]


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, fp, keys, grams): fingerprint of a text's different shingles, its shards, its shingles' hashes.

    ``keys`` has the first shingle in each order, ``grams`` the upper halves of all hashes, sorted, as 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in pieces(batches, 64):
            fps, keys, grams = [], [], []
            for t in b.column(1):
                h = np.unique(shingle_hashes(t.as_py(), shingle))
                fps.append(majority(h))
                keys.append(np.array([(h * x).min() for x in _FACTORS] if len(h) else [], np.uint64).view(np.int64).tolist())
                grams.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(grams, pa.binary()),
            ], ["id", "fp", "keys", "grams"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, fp bigint, keys array<bigint>, grams binary")


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    few, many = sorted((len(a), len(b)))
    if few < similarity * many:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (few + many - both) - 1e-9


def _checked_links(members: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): links of a spanning forest within each shard, from fingerprints within the radius whose shingles are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        now, nodes, fps, grams = None, [], [], []

        def found() -> Iterator[pa.RecordBatch]:
            pairs = list(_forest(fps, radius, lambda i, j: _alike(grams[i], grams[j], similarity)))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in pairs], ids) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for b in pieces([batch]):
                for shard, node, fp, its in zip(*(b.column(c).to_pylist() for c in ("shard", "node", "fp", "grams")), strict=True):
                    if shard != now:
                        yield from found()
                        now, nodes, fps, grams = shard, [], [], []
                    nodes.append(node)
                    fps.append(fp % (1 << 64))
                    grams.append(np.frombuffer(its, np.uint32))
        yield from found()

    name = members.schema["node"].dataType.simpleString()
    ids = to_arrow_type(members.schema["node"].dataType)
    return (
        members.select("shard", "node", "fp", "grams").repartition(partitions(members.sparkSession), "shard")
        .sortWithinPartitions("shard", "node").mapInArrow(run, f"a {name}, b {name}")
    )


def near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = _WIDE, block: int = 1000
) -> DataFrame:
    """(id, fp, component): every row, linked with texts whose sets of word shingles have at least this Jaccard similarity.

    At this similarity fingerprints differ in more bits than blocks of bits can serve, so shards are named by shingles: in
    each of ten random orders of all shingles by the first of a text's own.  Texts of similarity 0.8 miss each other in all
    ten orders once in ten million pairs, more alike ones more rarely, whatever the size of a shard.  Shards of the same
    texts (two near copies mostly share eight or more) are looked at once.  In a shard a BK-tree over the fingerprints of
    different shingles gives the candidates within ``radius`` bits; a link needs the similarity of the shingles' 32-bit
    hashes, and subtrees that are joined already are passed over.

    A shard of more than ``block`` texts is dealt by a hash into parts of about that many, and every two parts meet in a
    task of their own, so all its pairs are looked at while a task holds two parts.

    Rows with equal fingerprints are one node, so copies cost one row; texts without words are copies of each other.  Rows
    with one id are one document.  A row with a null id links nothing and has the component of the rows with its
    fingerprint (null if there are none).  An empty table gives no rows.  Other columns are not read.
    """
    prints = written(signatures(df, id_col, text_col, shingle))
    nodes = written(
        prints.groupBy("fp").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "keys"))).alias("n")).select("fp", F.col("n.id").alias("node"), "n.keys")
    )
    keyed = nodes.where("node is not null").select("fp", "node", F.posexplode("keys").alias("way", "key"))
    shards = keyed.groupBy("way", "key").agg(
        F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "fp", "node")).alias(f"texts{k}") for k in range(2)]
    ).where("n > 1").groupBy("n", "texts0", "texts1").agg(F.min(F.struct("way", "key")).alias("s")).select("s.way", "s.key", "n")
    chosen = keyed.join(shards, ["way", "key"]).groupBy("fp", "node").agg(F.collect_list(F.struct(
        F.xxhash64("way", "key").alias("home"), F.ceil(F.col("n") / block).alias("parts"))).alias("shards")).withColumnRenamed("node", "id")
    members = written(prints.select("id", "fp", "grams").join(chosen, ["id", "fp"]).dropDuplicates(["id", "fp"]).withColumnRenamed("id", "node"))
    ids = written(prints.select("id", "fp"))
    drop(prints)  # its hashes are half as large as the texts
    placed = members.select("node", "fp", "grams", F.explode("shards").alias("s")).select(
        "node", "fp", "grams", "s.home", "s.parts", F.pmod(F.xxhash64(F.lit("part"), "fp", "node"), "s.parts").alias("part")
    ).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).where("parts = 1 or other <> part")
    found = written(_checked_links(placed.withColumn("shard", F.xxhash64("home", F.least("part", "other"), F.greatest("part", "other"))), radius, similarity))
    drop(members)
    roots = connected_components(found.union(
        # fingerprints of one id are one document
        ids.where("id is not null").join(nodes.select("fp", "node"), "fp").where("id <> node").select("id", "node")
        .join(nodes.select(F.col("node").alias("id")), "id", "left_semi").distinct()
    ))
    drop(found)
    parts = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    return ids.join(parts, "fp").select("id", "fp", "component")


def hex_fingerprint(fp: str = "fp"):
    """A signed long as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
