"""Periodic runs of words: stretches that repeat one group of words at least three times, such as a looping generator leaves.

For a period p the words are cut by a grid of width p.  A run with at least three periods holds two neighbouring cells
that agree, so all (period, grid point) pairs, about n ln n of them, are looked at together: prefix hashes in numpy tell
which cells agree with the next one, a binary search over the same hashes gives how far the agreement goes to either
side (longest common extension), words are compared to verify it, and runs found from several grid points or with
multiples of their period are made one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Pairs of period and grid point that are looked at together.
_PAIRS = 1 << 19


def _values(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


class _Hashes:
    """Prefix hashes modulo 2^64: sums of word values times powers of a base."""

    def __init__(self, ids: np.ndarray):
        self.power = np.ones(len(ids) + 1, np.uint64)
        np.cumprod(np.full(len(ids), _BASE), out=self.power[1:])
        self.sum = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(_values(ids) * self.power[:-1], out=self.sum[1:])

    def agree(self, a: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether the words from ``a`` on and those from ``a + p`` on hash alike over ``length`` words."""
        s = self.sum
        return (s[a + length] - s[a]) * self.power[p] == s[a + p + length] - s[a + p]

    def reach(self, at: np.ndarray, p: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """The largest number of words, up to ``most``, over which ``at`` and ``at + p`` agree to one side; one binary search for all."""
        low, high = np.zeros_like(at), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.agree(at if forward else at - mid, mid, p)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low


def _cells(ids: np.ndarray, h: _Hashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grid point, period) of the first of each chain of cells that agree with the next cell."""
    n = len(ids)
    periods = np.arange(1, n // 3 + 1)
    cells = n // periods - 1
    ends = np.cumsum(cells)
    first = 0
    while first < len(periods):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
        count = cells[first:last]
        p = np.repeat(periods[first:last], count)
        at = (np.arange(len(p)) - np.repeat(ends[first:last] - count - done, count)) * p
        hit = np.flatnonzero(ids[at] == ids[at + p])
        at, p = at[hit], p[hit]
        same = h.agree(at, p, p)
        at, p = at[same], p[same]
        chained = np.zeros(len(at), bool)
        chained[1:] = (p[1:] == p[:-1]) & (at[1:] == at[:-1] + p[1:])
        yield at[~chained], p[~chained]
        first = last


def _compared(ids: np.ndarray, p: int, least: int) -> list[tuple[int, int, int]]:
    """All stretches of at least ``least`` words that keep period p, by comparing words."""
    n = len(ids)
    cut = np.concatenate([[-1], np.flatnonzero(ids[: n - p] != ids[p:]), [n - p]])
    length = np.diff(cut) - 1 + p
    return [(int(s), int(k), p) for s, k in zip(cut[:-1][length >= least] + 1, length[length >= least])]


def find_runs(ids: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period: smallest period, length at least ``least`` and ``times`` periods, not to be extended.

    ``times`` must be 3 or more; with fewer a run need not hold two neighbouring cells of its grid.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    n = len(ids)
    if n < max(least, 3):
        return np.zeros((0, 3), np.int64)
    h = _Hashes(ids)
    found = []
    for at, p in _cells(ids, h):
        if not len(at):
            continue
        start = at - h.reach(at, p, at.copy(), False)
        end = at + h.reach(at, p, n - p - at, True) + p
        long = end - start >= np.maximum(least, times * p)
        for s, e, q in zip(*(x[long].tolist() for x in (start, end, p))):
            if np.array_equal(ids[s : e - q], ids[s + q : e]):
                found.append((s, e - s, q))
            else:  # hashes agreed by chance
                found += _compared(ids, q, max(least, times * q))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.unique(np.array(found, np.int64), axis=0)  # by start, length, period
    once = np.ones(len(runs), bool)
    once[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)  # the same stretch again has a multiple of its period
    runs = runs[once]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words lie in some run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def strongest(runs: np.ndarray) -> list[int] | None:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period."""
    if not len(runs):
        return None
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-12)].tolist()
    return min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """(id, n_words, runs, strongest, collapsed) of each whole text.

    ``runs`` are structs (start, length, period) in words from 0, by start and period; ``strongest`` is one of them or
    null; ``collapsed`` is the text without words that only repeat the first period of a run, joined by one space.  A null
    or empty text has no words, no runs and an empty collapsed text.  Each row is looked at by itself, whatever its id;
    other columns are not read; an empty table gives no rows.  Memory grows with one text's words, not with the pairs.
    """
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    names = [id_col, "n_words", "runs", "strongest", "collapsed"]

    def one(text: str | None) -> tuple:
        words = WORD.findall(text or "")
        number: dict[str, int] = {}
        runs = find_runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64), least, times)
        if not len(runs):
            return len(words), [], None, " ".join(words)
        kept = " ".join(words[i] for i in np.flatnonzero(~repeated(len(words), runs)))
        as_row = lambda r: dict(zip(("start", "length", "period"), r))
        return len(words), [as_row(r) for r in runs.tolist()], as_row(strongest(runs)), kept

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [one(t) for t in b.column(1).to_pylist()]
            kinds = (pa.int64(), pa.list_(run), run, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*got), kinds))], names)

    kind = df.schema[id_col].dataType.simpleString()
    row = "struct<start: bigint, length: bigint, period: bigint>"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, f"{id_col} {kind}, n_words bigint, runs array<{row}>, strongest {row}, collapsed string")


def planted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with a loop of words planted in the text of every tenth id by hash: from some word on it goes round in a circle.

    With h the crc32 of the id in decimals, g = h div 10 and n words, words from a = g mod n on repeat the p words from a
    on, p = 1 + (n - a) div (3 + g mod 8), for texts with h mod 10 = 0; their words are joined by one space.  Rows with a
    null id or without words stay as they are.
    """
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = df.select(F.struct(*df.columns).alias("row"), F.crc32(F.col(id_col).cast("string")).alias("h"), words.alias("w"))
    rows = rows.withColumns({"g": F.expr("h div 10"), "n": F.size("w")}).withColumn("hit", F.expr("coalesce(h % 10 = 0 and n > 0, false)"))
    rows = rows.withColumn("a", F.expr("if(hit, int(g % n), null)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    text = F.expr("if(hit, array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' '), null)")
    return rows.select(*(F.when(F.col("hit"), text).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in df.columns))
