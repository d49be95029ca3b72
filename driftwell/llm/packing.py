"""Minimum bin slack packing of token pieces into sequences of a fixed capacity.

A document's whole windows of ``capacity`` tokens are sequences already; what is left of it (shorter than a
window) goes to a pool.  A sequence starts with the pool's longest piece; a subset-sum dynamic programme over a
bitset, bit *s* set if *s* tokens can be filled, takes the lengths still in the pool, as often as each is there, until
the rest of the window can be filled exactly, and the counts of each length are traced back through the bitsets.  If no
choice fills it, the fullest one is taken and one more piece is cut to fill the gap; its tail goes back to the pool.

Each task packs its own documents, in pools of a bounded number of pieces, so nothing is shuffled and only a task's
last sequence can be short.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks
from .tokens import encoder

CAPACITY = 1024


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length come closest to ``room`` tokens without going beyond.

    Longer lengths are tried first; with an exact fill found, the rest are not looked at.  An empty pool or no room
    gives an empty choice.
    """
    full, reach, layers = (1 << room + 1) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        layers.append((length, reach))
        for _ in range(min(counts[length], room // length)):
            reach |= reach << length & full
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        while not before >> total & 1:
            total -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


class Pool:
    """Pieces (document, start, ids, tokens of the document) by length."""

    def __init__(self, capacity: int):
        self._capacity, self._by_length, self.size, self.tokens = capacity, defaultdict(deque), 0, 0

    def put(self, piece: tuple) -> None:
        self._by_length[n := len(piece[2]) // 4].append(piece)
        self.size += 1
        self.tokens += n

    def _take(self, length: int) -> tuple:
        at = self._by_length[length]
        piece = at.popleft()
        if not at:
            del self._by_length[length]
        self.size -= 1
        self.tokens -= length
        return piece

    def sequence(self) -> list[tuple]:
        """The pieces of the next sequence, taken out of the pool."""
        longest = max(self._by_length)
        out, room = [self._take(longest)], self._capacity - longest
        for length, n in best_fill({k: len(v) for k, v in self._by_length.items()}, room).items():
            out += [self._take(length) for _ in range(n)]
            room -= length * n
        if room and self.size:
            doc, start, ids, total = self._take(max(self._by_length))
            out.append((doc, start, ids[: 4 * room], total))
            self.put((doc, start + room, ids[4 * room :], total))
        return out


def pack(
    df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, pool: int = 4096,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): every piece of every document's ids.

    A document's ids are those of its whole text with ``end_id`` at the end; ``ids`` holds the piece's as
    little-endian unsigned 32-bit integers.  Each id lies in one piece.  Sequences hold ``capacity`` ids but for the
    last of a task.  ``pool``, or ``capacity`` if that is more, bounds the pieces in memory.  A null or empty text is the end id alone; null ids and
    repeated rows are packed like others (each row by itself); other columns are not read; an empty table gives no
    pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, enc, end = TaskContext.get().partitionId() << 40, encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        rest, done = Pool(capacity), []

        def out() -> pa.RecordBatch:
            columns = [pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def close(parts: list[tuple]) -> None:
            nonlocal number
            at = 0
            for doc, start, ids, total in parts:
                done.append((doc, start, n := len(ids) // 4, ids, total, number, at))
                at += n
            number += 1

        kinds = None
        for b in blocks(batches, 1):
            kinds = kinds or [b.schema.field(0).type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3]
            for doc, ids in zip(b.column(0).to_pylist(), enc.many(b.column(1)), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    close([(doc, start, ids[4 * start : 4 * (start + capacity)], total)])
                    if len(done) >= 1024:
                        yield out()
                if whole < total:
                    rest.put((doc, whole, ids[4 * whole :], total))
                if rest.size >= pool:
                    while rest.size > pool // 2 and rest.tokens >= capacity:
                        close(rest.sequence())
                    if len(done) >= 1024:
                        yield out()
        while rest.size:
            close(rest.sequence())
            if len(done) >= 1024:
                yield out()
        if done:
            yield out()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"{id_col} {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
