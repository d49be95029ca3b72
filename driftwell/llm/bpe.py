"""Byte-level BPE as a streaming transducer, and its inverse.

How far ahead must one look?  Take a part of a text whose right end is not known yet.  Two continuations give the
same merges up to a boundary D, at first the known end.  If a rule (a, b) joins across D in one of them only, D moves
left by the length of a; the next rule that can move it on must be a later one, (c, d), with c ending at the new D and
d a token that a opens.  So the farthest D can move is the heaviest chain of rules, each later than the one before,
whose right side is opened by the left side of the one before, weighed by the lengths of left sides.  ``lookahead`` is
that weight: tokens that end at least so many bytes before the known end are stable and are emitted.
"""

from __future__ import annotations

import codecs
import heapq
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces

#: The splitting pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
#: Two parts that become one if the right letter follows.
_OPEN = {"'r", "'v", "'l"}
#: A run that may go on beyond what has been read, by the kind of its last character.
_RUNS = [regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*")]


def byte_letters() -> dict[str, int]:
    """The letter a vocabulary file writes for each byte: itself if it can be printed, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Merges:
    """The merge list of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        letters, vocab = byte_letters(), d["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        spelled = {t: bytes(map(letters.__getitem__, t)) for t in vocab}
        self.bytes_of = {i: spelled[t] for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        rules = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        #: (left, right) -> (rank, the token they make)
        self.rule = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(rules)}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        left_of, best, most = {}, {}, 0
        for (a, b), (_, made) in self.rule.items():
            opened, x = 0, b
            while x is not None:
                opened, x = max(opened, best.get(x, 0)), left_of.get(x)
            weight = len(self.bytes_of[a]) + opened
            best[a] = max(best.get(a, 0), weight)
            most = max(most, weight)
            left_of.setdefault(made, a)
        return most

    def short(self, ids: list[int]) -> list[int]:
        """Merges a few tokens in place: the first pair of least rank, until none has a rule."""
        get, none = self.rule.get, (1 << 60, 0)
        rules = [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while rules and (least := min(rules)) is not none:
            i = rules.index(least)
            ids[i : i + 2] = [least[1]]
            del rules[i]
            if i < len(rules):
                rules[i] = get((ids[i], ids[i + 1]), none)
            if i:
                rules[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def tokens(self, raw: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in raw]
        if len(ids) <= 48:
            return self.short(ids)
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        todo = [(r[0], i, r[1]) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.rule.get(p))]
        heapq.heapify(todo)
        while todo:
            rank, i, made = heapq.heappop(todo)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or (r := self.rule.get((ids[i], ids[j]))) is None or r != (rank, made):
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self.rule.get((ids[left], ids[right]))):
                    heapq.heappush(todo, (r[0], left, r[1]))
        return [x for x in ids if x >= 0]


class Transducer:
    """Bytes of one part in, stable tokens out; holds ``lookahead`` bytes and one block more at most."""

    def __init__(self, merges: Merges, block: int = 4096):
        self._m, self._pending, self._block = merges, b"", block

    def feed(self, raw: bytes) -> Iterator[int]:
        for i in range(0, len(raw), self._block):
            self._pending += raw[i : i + self._block]
            if len(self._pending) < self._m.lookahead + self._block:
                continue
            end, at = len(self._pending) - self._m.lookahead, 0
            for t in self._m.tokens(self._pending):
                if at + (n := len(self._m.bytes_of[t])) > end:
                    break
                at += n
                yield t
            self._pending = self._pending[at:]

    def finish(self) -> Iterator[int]:
        yield from self._m.tokens(self._pending)
        self._pending = b""


class TokenStream:
    """Tokens of a text that comes in chunks; memory does not grow with it, however long its runs are.

    A part is closed once something follows it.  Closed parts go through the transducer, or are looked up in ``known`` if
    they have been through it lately.  A run of over ``LONG`` characters goes to the transducer as it comes, all but its
    last character, which may open the next part.
    """

    LONG = 4096

    def __init__(self, merges: Merges, known: dict[str, bytes], most: int = 400_000):
        self._merges, self._known, self._most = merges, known, most
        self._held, self._run, self._transducer = "", None, Transducer(merges)

    def _new(self, part: str) -> bytes:
        raw = part.encode()
        ids = pack_ids([*self._transducer.feed(raw), *self._transducer.finish()])
        if len(part) <= 32:
            if len(self._known) >= self._most:  # the half learned first stays: common parts come early
                for p in list(islice(self._known, self._most // 2, None)):
                    del self._known[p]
            self._known[part] = ids
        return ids

    def _closed(self, parts: list[str]) -> bytes:
        try:
            return b"".join(map(self._known.__getitem__, parts))
        except KeyError:
            return b"".join([self._known.get(p) or self._new(p) for p in parts])

    def feed(self, chunk: str) -> bytes:
        """The ids that have become stable, as little-endian unsigned 32-bit integers."""
        held, out = self._held + chunk, b""
        if self._run:
            n = self._run.match(held).end()
            if n == len(held):  # the run goes on
                self._held = held[-1:]
                return pack_ids([*self._transducer.feed(held[:-1].encode())])
            stop = n - 1 if self._run is _RUNS[3] and n else n  # of white space before another part, the last stays out
            out = pack_ids([*self._transducer.feed(held[:stop].encode()), *self._transducer.finish()])
            held, self._run = held[stop:], None
        parts = _SPLIT.findall(held)
        open_ = 2 if len(parts) > 1 and "".join(parts[-2:]) in _OPEN else 1
        out += self._closed(parts[:-open_])
        held = "".join(parts[-open_:])
        if len(held) > self.LONG:
            self._run = next(r for r in _RUNS if r.match(held[-1]).end())
            out += pack_ids([*self._transducer.feed(held[:-1].encode())])
            held = held[-1:]
        self._held = held
        return out

    def finish(self) -> bytes:
        held, self._held = self._held, ""
        if self._run:
            self._run = None
            return pack_ids([*self._transducer.feed(held.encode()), *self._transducer.finish()])
        return self._closed(_SPLIT.findall(held))


class StreamEncoder:
    """Encodes as the ``tokenizers`` library does with the same file, added tokens in a text included."""

    def __init__(self, path: str, memo: int = 400_000, chunk: int = 4096):
        self.merges, self._chunk = Merges(path), chunk
        self._most, self._known = memo, {}
        added = sorted(self.merges.added, key=len, reverse=True)
        self._cut = regex.compile("|".join(map(regex.escape, added))) if added else None
        self._opens, self._longest = {a[0] for a in added}, max(map(len, added), default=0)

    def blocks(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of a text in chunks, as they become stable; an added token ends what stands before it."""
        stream, held = TokenStream(self.merges, self._known, self._most), ""
        for chunk in chunks:
            held += chunk
            if any(map(held.__contains__, self._opens)):
                # only what can no longer be a part of an added token is passed on
                done, sure = 0, len(held) - self._longest
                for m in self._cut.finditer(held):
                    if m.start() > sure:
                        break
                    yield from self._added(stream, held[done : m.start()], m.group())
                    done = m.end()
                sure = max(done, sure)
                yield stream.feed(held[done:sure])
                held = held[sure:]
            else:
                yield stream.feed(held)
                held = ""
        done = 0
        for m in self._cut.finditer(held) if self._cut else ():
            yield from self._added(stream, held[done : m.start()], m.group())
            done = m.end()
        yield stream.feed(held[done:])
        yield stream.finish()

    def _added(self, stream: TokenStream, before: str, token: str) -> Iterator[bytes]:
        yield stream.feed(before)
        yield stream.finish()
        yield pack_ids([self.merges.added[token]])

    def one(self, text: str | None) -> bytes:
        n = self._chunk
        return b"".join(self.blocks(text[i : i + n] for i in range(0, len(text), n))) if text else b""


def decode_stream(ids: Iterable[bytes], merges: Merges) -> Iterator[str]:
    """Text of blocks of packed ids; bytes of a character that a block cuts wait for the next one.

    Bytes that are no UTF-8 become U+FFFD, ids that are no tokens nothing, as do bytes at a block's end that make no whole id.
    """
    state, of = codecs.getincrementaldecoder("utf-8")("replace"), merges.bytes_of
    for block in ids:
        yield state.decode(b"".join([of.get(i, b"") for i in np.frombuffer(block, "<u4", len(block) // 4).tolist()]))
    yield state.decode(b"", final=True)


@lru_cache(maxsize=1)
def _encoder(path: str) -> StreamEncoder:
    return StreamEncoder(path)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of each whole text, and with ``decoded`` the text that the ids give back.

    ``ids`` are little-endian unsigned 32-bit integers.  A null text is an empty one (no ids).  Every row is encoded by
    itself: null ids, repeated rows and an empty table need no rule.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        for b in pieces(batches):
            ids = [enc.one(t) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(["".join(decode_stream((x[i : i + 65536] for i in range(0, len(x), 65536)), enc.merges)) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids", "decoded"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from packed ids; null ids give a null text, ids that are no tokens and bytes that make no whole id nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _encoder(vocabulary).merges
        for b in pieces(batches):
            texts = [None if x is None else "".join(decode_stream((x[i : i + 65536] for i in range(0, len(x), 65536)), merges)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"{id_col} {kind}, text string")
