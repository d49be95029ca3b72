"""Small helpers for mapInArrow functions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: What Python workers keep from task to task, as functions that let go of it; an operator that needs none of it calls ``lighten``.
KEPT: list[Callable[[], None]] = []


def lighten() -> None:
    """Frees what tasks of other operators have left in this Python worker, which Spark uses again for this one."""
    if KEPT:
        for let_go in KEPT:
            let_go()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        return


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that Python holds few texts at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def blocks(batches: Iterator[pa.RecordBatch], column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts in a column are ``size`` bytes at most, or one row that is longer."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, size + (ends[i - 1] if i else 0), "right")))
            yield b.slice(i, j - i)
            i = j


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which no key is cut in two; the input must be sorted by the key, without nulls in it."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        if k[0] != k[-1]:
            at = int(np.argmax(k.to_numpy(zero_copy_only=False) == k[-1].as_py()))
            yield pa.Table.from_batches([*kept, b.slice(0, at)])
            kept = [b.slice(at)]
        elif kept and kept[-1].column(key)[-1] != k[0]:
            yield pa.Table.from_batches(kept)
            kept = [b]
        else:
            kept.append(b)
    if kept:
        yield pa.Table.from_batches(kept)


def binary_list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column of 32-bit integers from its values end to end and the number in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)))
