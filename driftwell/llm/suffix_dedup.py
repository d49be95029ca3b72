"""Repeated byte strings, found by refining buckets of sampled suffixes.

Every string of ``length`` bytes (a window) has one anchor in it: the leftmost of its 32-byte grams with the least hash.
Equal windows have equal anchors at equal places, so suffixes need only be bucketed where an anchor is, about one
position in 35.  Buckets are named by bucket identifiers of their parts, built by doubling: 8-grams as integers, then
the pair of identifiers at i and i+8, i+16, i+32, ... stands for twice the length.

1. 32-grams with very many buckets (a passage that many documents share, each in other surroundings) are counted
   first, in a sketch of bounded size a task; the widest ones are known to all tasks.
2. Each task buckets the anchors of its documents by (32-gram, all bytes of the windows that the anchor stands for).
   Of a bucket only the first member goes on, the others are repeats already and may go to any task.  First members of
   many chunks of texts are held and merged before they go on, so a passage in very many documents is about a row a task.
3. Anchors are shuffled by their 32-gram, those of wide ones by 32-gram and bucket, and buckets merged: all but the
   first of a bucket are repeats.  A 32-gram with one bucket is done; the first members of several buckets may still
   share some of their windows.
4. For those the bytes around the anchor are fetched and the bucket of each 32-gram is refined by sorting on bucket
   pointers of later offsets (8, 16, 32, 64, then the whole window), pointers of one round naming pairs in the next;
   windows alone in their bucket leave after each round.  The members of a wide 32-gram do not meet in one task: each
   task names the buckets of their windows by the same doubling, and windows meet by their last bucket.
5. Repeated windows are joined to their documents and their bytes cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import lighten, pieces, whole_groups
from .shared import partitions, written

LENGTH = 100
_Q = 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 19
#: Buckets from which a 32-gram is wide, how many wide ones are known to all tasks (the widest), and the size of a task's sketch.
#: A 32-gram that is not known has at most about that many buckets, or this share of all, and three more for each task.
_WIDE, _KNOWN = 1000, 1 << 18
#: First members that a task merges before they go on (about 13 MB of texts).
_HELD = 400_000


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket identifier of two neighbours' identifiers."""
    x = (a ^ a >> np.uint64(32)) * _A + b
    x = (x ^ x >> np.uint64(29)) * _B
    return x ^ x >> np.uint64(32)


def _grams(raw: np.ndarray) -> np.ndarray:
    """The 8-gram at each position as an integer; bytes beyond the end are 0."""
    x = np.zeros(len(raw) + 8, np.uint64)
    x[: len(raw)] = raw
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    return (x[:-4] | x[4:] << np.uint64(32))[: len(raw)]


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, 32-gram, content) for all windows of texts laid end to end in ``raw``."""
    none = np.zeros(0, np.int64)
    width = length - _Q + 1
    if len(raw) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    g = _grams(raw)
    g16 = _pair(g[:-8], g[8:])
    ids = _pair(g16[:-16], g16[16:])[: len(raw) - _Q + 1]
    least, span = ids, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    inside = np.zeros(len(raw) + 1, np.int8)
    long = ends - starts >= length
    inside[starts[long]] += 1
    inside[ends[long] - length + 1] -= 1
    ok = np.cumsum(inside[: len(least)], dtype=np.int8).astype(bool)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
    begin = np.unique(np.concatenate([np.flatnonzero(new), starts[starts < len(least)]]))
    end = np.append(begin[1:], len(least)) - 1
    begin, end = begin[ok[begin]], end[ok[begin]]
    if not len(begin):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = begin + np.lib.stride_tricks.sliding_window_view(ids, width)[begin].argmin(axis=1)
    if (again := np.flatnonzero(at < end)).size:  # the same gram comes again before the windows change
        more = [(at, begin, np.minimum(at, end))]
        for i in again:
            here = begin[i] + np.flatnonzero(ids[begin[i] : end[i] + width] == least[begin[i]])
            of = here[np.searchsorted(here, np.arange(at[i] + 1, end[i] + 1))]
            cut = np.flatnonzero(np.diff(of, prepend=-1))
            more.append((of[cut], at[i] + 1 + cut, at[i] + np.append(cut[1:], len(of))))
        at, begin, end = map(np.concatenate, zip(*more, strict=True))
    half = lambda i: _pair(ids[i], ids[i + 32])
    rest = length - 64
    whole = lambda i: _pair(half(i), half(i + rest))
    content = _pair(_pair(whole(begin), whole(end)), ((at - begin) * 256 + (at - end)).astype(np.uint64))
    return at, begin, end, ids[at], content


def _first(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """In the given order, which rows differ from the one before in any key."""
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return new


def _distinct(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The order without what equals the one before in all keys: the same place of one document that stands in several rows."""
    return order[_first(order, *keys)]


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple]]:
    """(id, version, text) of about half a MB of texts in order (a longer text is a chunk of its own)."""
    rows, held = [], 0
    for b in pieces(batches):
        for i, v, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if t is None or len(t) < length:
                continue
            if held and held + len(t) > _CHUNK:
                yield list(dict.fromkeys(sorted(rows, key=lambda r: r[:2])))
                rows, held = [], 0
            rows.append((i, v, t))
            held += len(t)
    if rows:
        yield list(dict.fromkeys(sorted(rows, key=lambda r: r[:2])))


def _anchors_of(rows: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """What ``anchors`` finds in a chunk, and where each text starts and ends."""
    sizes = np.array([len(r[2]) for r in rows], np.int64)
    ends = np.cumsum(sizes)
    return *anchors(np.frombuffer(b"".join(r[2] for r in rows), np.uint8), ends - sizes, ends, length), ends - sizes, ends


def _sketch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Step 1: 32-grams with several buckets in a task, how many, and a bit for each of 64 classes of them.

    The count is too low by less than the task's rows / ``_KNOWN``, and counts a bucket once in 16 chunks; the bits tell
    few buckets that come in very many tasks from many buckets.
    """
    lighten()
    kept, counts, masks, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), []

    def fold() -> None:
        nonlocal kept, counts, masks
        gram, content = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((content, gram))
        order = order[_first(order, gram, content)]
        gram, bit = gram[order], np.uint64(1) << (content[order] & np.uint64(63))
        at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        more, n = gram[at], np.diff(np.append(at, len(gram)))
        mask = np.bitwise_or.reduceat(bit, at) if len(at) else bit
        kept, of = np.unique(np.concatenate([kept, more]), return_inverse=True)
        counts = np.bincount(of, np.concatenate([counts, n]), len(kept)).astype(np.int64)
        both = np.zeros(len(kept), np.uint64)
        np.bitwise_or.at(both, of, np.concatenate([masks, mask]))
        masks = both
        if len(kept) > _KNOWN:
            counts -= np.partition(counts, -_KNOWN - 1)[-_KNOWN - 1]
            kept, counts, masks = kept[counts > 0], counts[counts > 0], masks[counts > 0]

    for rows in _chunks(batches, length):
        _, _, _, gram, content, *_ = _anchors_of(rows, length)
        held.append((gram, content))
        if len(held) == 16:
            fold()
    if held:
        fold()
    several = counts > 3
    yield pa.RecordBatch.from_arrays([pa.array(kept[several].view(np.int64)), pa.array(counts[several]), pa.array(masks[several].view(np.int64))], ["gram", "n", "mask"])


def wide_grams(docs: DataFrame, length: int) -> np.ndarray:
    """The widest 32-grams with at least ``_WIDE`` buckets, ``_KNOWN`` at most, sorted."""
    found = docs.mapInArrow(lambda b: _sketch(b, length), "gram bigint, n bigint, mask bigint").groupBy("gram").agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"))
    # a thousand buckets leave no class without one, but for a chance of about 1 in 100,000
    widest = found.where((F.col("n") >= _WIDE) & (F.bit_count("mask") >= min(64, _WIDE // 2))).orderBy(F.desc("n"), "gram").limit(_KNOWN).select("gram").toArrow()
    return np.sort(widest["gram"].to_numpy().view(np.uint64))


def _firsts(rows: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of rows (gram, content, id, version, place): 1 for the first of its bucket, 0 for a repeat, -1 for the same place once more."""
    gram, content, ids, version, place = rows
    mark = np.ones(len(gram), np.int8)
    _, of, sizes = np.unique(_pair(gram, content), return_inverse=True, return_counts=True)
    several = np.flatnonzero(sizes[of] > 1)
    g, c, i, v, p = (x[several] for x in rows)
    order = np.lexsort((p, v, i, c, g))
    mark[several[order[~_first(order, g, c)]]] = 0
    mark[several[order[~_first(order, g, c, i, v, p)]]] = -1
    return mark


def _sample(batches: Iterator[pa.RecordBatch], length: int, wide: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Step 2; a row's ``role`` is 1 for a repeat, 2 for the first member of a bucket of a wide 32-gram, else 0."""
    lighten()
    held: list[tuple[np.ndarray, ...]] = []

    def batch(gram, content, ids, version, place, role) -> pa.RecordBatch:
        columns = (gram.view(np.int64), content.view(np.int64), ids, version, place, role.astype(np.int8))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["gram", "content", "id", "version", "place", "role"])

    def merged() -> pa.RecordBatch:
        rows = tuple(map(np.concatenate, zip(*held, strict=True)))
        held.clear()
        mark = _firsts(rows)
        rows, mark = tuple(x[mark >= 0] for x in rows), mark[mark >= 0]
        gram = rows[0]
        known = wide[np.minimum(np.searchsorted(wide, gram), len(wide) - 1)] == gram if len(wide) else np.zeros(len(gram), bool)
        return batch(*rows, np.where(mark == 1, 2 * known, 1))

    for rows in _chunks(batches, length):
        at, begin, end, gram, content, starts, ends = _anchors_of(rows, length)
        if not len(at):
            continue
        order = np.lexsort((at, content, gram))
        new = _first(order, gram, content)
        doc = np.searchsorted(ends, at[order], "right")
        at, begin, end = at[order] - starts[doc], begin[order] - starts[doc], end[order] - starts[doc]
        ids, versions = np.array([r[0] for r in rows], np.int64)[doc], np.array([r[1] for r in rows], np.int32)[doc]
        found = (gram[order], content[order], ids, versions, at << 16 | (at - begin) << 8 | (at - end))
        if not new.all():
            yield batch(*(x[~new] for x in found), np.ones(int((~new).sum()), np.int8))
        held.append(tuple(x[new] for x in found))
        if sum(len(x[0]) for x in held) >= _HELD:
            yield merged()
    if held:
        yield merged()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 over anchors sorted by 32-gram, first members of a bucket in one task; ``refine`` 1: by 32-gram, 2: by window."""

    def some(t: pa.Table) -> pa.RecordBatch:
        gram, content, ids, version, place, role = (t[c].to_numpy() for c in ("gram", "content", "id", "version", "place", "role"))
        again = role == 1
        order = _distinct(np.lexsort((place, version, ids, again, content, gram)), gram, content, again, ids, version, place)
        new = _first(order, gram, content)
        group = np.cumsum(_first(order, gram)) - 1
        classes = np.bincount(group, weights=new)[group]
        gone = ~new | again[order]
        refine = np.where(gone, 0, np.where(role[order] == 2, 2, classes > 1)).astype(np.int8)
        at = np.flatnonzero(gone | (refine > 0))
        return pa.RecordBatch.from_arrays([pa.array(x[order[at]]) for x in (gram, ids, version, place)] + [pa.array(refine[at])], ["gram", "id", "version", "place", "refine"])

    lighten()
    held, rows = [], 0
    for t in whole_groups(batches, "gram"):
        held.append(t)
        rows += t.num_rows
        if rows >= 100_000:
            yield some(pa.concat_tables(held))
            held, rows = [], 0
    if held:
        yield some(pa.concat_tables(held))


def _pointers(keys: np.ndarray, where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket pointers (1 and up; 0 where there is none) of the positions ``where``, and the size of each bucket."""
    _, of, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    out = np.zeros(size, np.int64)
    out[where] = of + 1
    return out, np.append(0, sizes)


def refined(raw: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A bucket pointer of each window's ``length`` bytes, equal for equal windows; 0 for one alone in its bucket."""
    out = np.zeros(len(windows), np.int64)
    alive = np.arange(len(windows))
    size = len(raw) + length
    # Offsets at which pointers of each width are wanted so that the last pair covers the window.
    wide = {64: [0, length - 64]}
    wide[32] = sorted({o + d for o in wide[64] for d in (0, 32)})
    wide[16] = sorted({o + d for o in wide[32] for d in (0, 16)})
    offsets = {8: sorted({o + d for o in wide[16] for d in (0, 8)}), **wide}
    grams = _grams(np.append(raw, np.zeros(length, np.uint8)))
    pointer = None
    for step in (8, 16, 32, 64):
        mark = np.zeros(size, bool)
        for o in offsets[step]:
            mark[windows[alive] + o] = True
        where = np.flatnonzero(mark)
        keys = grams[where] if step == 8 else pointer[where] << 32 | pointer[where + step // 2]
        pointer, sizes = _pointers(keys, where, size)
        alive = alive[sizes[pointer[windows[alive]]] > 1]
        if not len(alive):
            return out
    w = windows[alive]
    _, of, sizes = np.unique(pointer[w] << 32 | pointer[w + length - 64], return_inverse=True, return_counts=True)
    out[alive] = np.where(sizes[of] > 1, of + 1, 0)
    return out


def _refine(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Step 4 over members and single windows: runs of windows that also start earlier."""

    def some(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(parts)
        single = t["around"].is_null().to_numpy()
        if single.any():
            yield _seen_before(t.filter(pa.array(single)), length)
        if not single.all():
            yield members(t.filter(pa.array(~single)))

    def members(t: pa.Table) -> pa.RecordBatch:
        ids, version, start = (t[c].to_numpy() for c in ("id", "version", "start"))
        keep = _distinct(np.lexsort((start, version, ids)), ids, version, start)
        if len(keep) < len(ids):
            t, ids, version, start = t.take(pa.array(keep)), ids[keep], version[keep], start[keep]
        around = t["around"].to_pylist()
        sizes = np.fromiter(map(len, around), np.int64, len(around))
        base = np.cumsum(sizes) - sizes
        n = sizes - length + 1
        member = np.repeat(np.arange(len(n)), n)
        local = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
        pointer = refined(np.frombuffer(b"".join(around), np.uint8), base[member] + local, length)
        at = np.flatnonzero(pointer)
        m, begin = member[at], start[member[at]] + local[at]
        order = np.lexsort((begin, version[m], ids[m], pointer[at]))
        again = np.zeros(len(pointer), bool)
        again[at[order[~_first(order, pointer[at])]]] = True
        at = np.flatnonzero(again)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (member[at[1:]] != member[at[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(first) else first
        m = member[at[first]]
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (ids[m], version[m], start[m] + local[at[first]], start[m] + local[at[last]] + length)], ["id", "version", "start", "end"]
        )

    lighten()
    held, rows = [], 0
    for t in whole_groups(batches, "gram"):
        held.append(t)
        rows += t.num_rows
        if rows >= 8_000:
            yield from some(held)
            held, rows = [], 0
    if held:
        yield from some(held)


def _seen_before(t: pa.Table, length: int) -> pa.RecordBatch:
    """Spans of single windows: those marked ``again``, and all but the first of a bucket."""
    gram, content, ids, version, start, again = (t[c].to_numpy(zero_copy_only=False) for c in ("gram", "content", "id", "version", "start", "again"))
    order = _distinct(np.lexsort((start, version, ids, again, content, gram)), gram, content, again, ids, version, start)
    at = order[~_first(order, gram, content) | again[order].astype(bool)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], version[at], start[at], start[at] + length)], ["id", "version", "start", "end"])


def _single_windows(rows: list[tuple], length: int) -> pa.RecordBatch:
    """A row for each window of members of wide 32-grams, all but the first of a bucket marked ``again``."""
    rows = list({r[:4]: r for r in rows}.values())
    sizes = np.fromiter((len(r[4]) for r in rows), np.int64, len(rows))
    base = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    member = np.repeat(np.arange(len(rows)), n)
    local = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
    g = _grams(np.append(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), np.zeros(length, np.uint8)))
    g16 = _pair(g[:-8], g[8:])
    g32 = _pair(g16[:-16], g16[16:])
    g64 = _pair(g32[:-32], g32[32:])
    w = base[member] + local
    content = _pair(g64[w], g64[w + length - 64]).view(np.int64)
    gram, ids, version, start = (np.array([r[k] for r in rows], np.int32 if k == 2 else np.int64)[member] for k in range(4))
    start = start + local
    order = np.lexsort((start, version, ids, content, gram))
    columns = [pa.array(x[order]) for x in (gram, content, ids, version, start)]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.nulls(len(order), pa.binary()), pa.array(~_first(order, gram, content))], ["gram", "content", "id", "version", "start", "around", "again"]
    )


_ANCHORS = "gram bigint, content bigint, id bigint, version int, place bigint, role tinyint"
_MERGED = "gram bigint, id bigint, version int, place bigint, refine tinyint"
_MEMBERS = "gram bigint, content bigint, id bigint, version int, start bigint, around binary, again boolean"


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, version, spans): for each text with repeats, sorted (start, end) byte spans, which may overlap.

    A span is a run of windows of ``length`` bytes that also start earlier: in a smaller id, or earlier in the same text.
    Ids are integers; a null one counts as less than all others.  ``version`` is the hash of the text: rows that repeat id
    and text are one document (no repeat of themselves; each has the document's spans, and null ids count as one id), rows
    that repeat an id with another text are ordered by the hash.
    """
    if length < 96 or length > 128:
        raise ValueError("windows of 96 to 128 bytes")
    n = partitions(df.sparkSession)
    docs = df.select(_id(id_col), _version(text_col), F.col(text_col).cast("binary").alias("text"))
    wide = df.sparkSession.sparkContext.broadcast(wide_grams(docs, length))  # 8 bytes for each of at most _KNOWN
    # repeats are spread, as no task needs them; first members meet by 32-gram, those of wide ones by bucket
    meet = F.when(F.col("role") == 1, F.hash("id", "place")).when(F.col("role") == 2, F.hash("content")).otherwise(0)
    anchored = docs.mapInArrow(lambda b: _sample(b, length, wide.value), _ANCHORS)
    merged = written(anchored.repartition(n, "gram", meet).sortWithinPartitions("gram").mapInArrow(_merge, _MERGED))
    open_ = merged.where("refine > 0").groupBy("id", "version").agg(F.collect_list(F.struct("gram", "place", "refine")).alias("places"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        wide = []
        for b in pieces(batches, 64):
            rows = []
            for i, v, text, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for p in places:
                    at = p["place"] >> 16
                    begin, end = at - (p["place"] >> 8 & 255), at - (p["place"] & 255)
                    (wide if p["refine"] == 2 else rows).append((p["gram"], i, v, begin, text[begin : end + length]))
            if rows:
                gram, ids, version, start, text = zip(*rows, strict=True)
                columns = [gram, [0] * len(rows), ids, version, start, text, [False] * len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, fields, strict=True)], names)
            if len(wide) >= 8000:
                yield _single_windows(wide, length)
                wide = []
        if wide:
            yield _single_windows(wide, length)

    names = [x.split(" ")[0] for x in _MEMBERS.split(", ")]
    fields = pa.schema(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()), strict=True))
    members = (
        docs.join(open_, ["id", "version"]).mapInArrow(around, _MEMBERS)
        .repartition(n, "gram", "content", F.when(F.col("again"), F.hash("id", "start")).otherwise(0)).sortWithinPartitions("gram")
    )
    shared = members.mapInArrow(lambda b: _refine(b, length), "id bigint, version int, start bigint, end bigint")
    at = F.shiftright("place", 16)
    whole = merged.where("refine = 0").select(
        "id", "version", (at - F.shiftright("place", 8).bitwiseAND(F.lit(255))).alias("start"), (at - F.col("place").bitwiseAND(F.lit(255)) + length).alias("end")
    )
    return whole.union(shared).groupBy("id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _id(name: str):
    return F.coalesce(F.col(name).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("id")


def _version(name: str):
    return F.hash(name).alias("version")


_CUT = "struct<kept:binary,n_bytes:bigint,n_removed:bigint,n_spans:bigint>"


def _cut_udf(text: bool = False):
    """Cuts spans out of a text; with ``text`` what is kept is text again, without bytes left of a character that a cut goes through."""
    kind = pa.struct([("kept", pa.string() if text else pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    def run(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for i in range(len(texts)):  # one text at a time, not all of a batch
            whole = texts[i].as_py() or b""
            if not starts[i].is_valid or not len(starts[i]):
                out.append((whole, len(whole), 0, 0))
                continue
            a, b = starts[i].values.to_numpy(), np.maximum.accumulate(ends[i].values.to_numpy())
            new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
            a, b = a[new], np.append(b[new[1:] - 1], b[-1])
            kept = b"".join(whole[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(whole)], strict=True))
            out.append((kept, len(whole), len(whole) - len(kept), len(a)))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        if text:
            columns[0] = [x.decode("utf-8", "ignore") for x in columns[0]]
        return pa.StructArray.from_arrays([pa.array(c, kind.field(k).type) for k, c in enumerate(columns)], fields=list(kind))

    return F.arrow_udf(run, _CUT.replace("kept:binary", "kept:string") if text else _CUT)


def dedup_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(row, kept, n_bytes, n_removed, n_spans): each row of ``df`` as a struct, and its bytes without repeats.

    Every byte of a text's UTF-8 form that a string of ``length`` bytes covers which also starts earlier (see
    ``repeated_spans``) goes; overlaps count, and what is left is not judged again.  A null text is empty.  Texts shorter
    than ``length`` and an empty table have no repeats.  Columns of ``df`` stay inside ``row``, whatever their names.
    """
    return _cut(df, id_col, text_col, length)


def _cut(df: DataFrame, id_col: str, text_col: str, length: int, text: bool = False) -> DataFrame:
    spans = repeated_spans(df, id_col, text_col, length)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _id(id_col), _version(text_col))
    cut = _cut_udf(text)(F.col(f"row.`{text_col}`").cast("binary"), F.col("spans.start"), F.col("spans.end"))
    return rows.join(spans, ["id", "version"], "left").withColumn("cut", cut).select("row", "cut.*")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of ``df`` with repeats cut out of their texts; bytes left of a character that a cut goes through go too."""
    done = _cut(df, id_col, text_col, length, text=True)  # one Python worker a task does both
    return done.select(*[(F.col("kept") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns])
