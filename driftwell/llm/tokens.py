"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memo of parts already encoded.

A byte-level BPE with the usual splitting pattern always starts a new part at a space that a non-space follows,
whatever stands before it.  So a text is cut there, each part is looked up in a memo, and only parts not seen
lately go to the library, many in one call.  Texts that hold an added token's own string go to it whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow import KEPT

#: White space beside white space or at an end: what stands there decides where the parts are.
_ODD = re.compile(r"\s\s|^\s|\s\Z")


class PartMemo:
    """``one(text)`` returns the ids of a text as little-endian unsigned 32-bit integers, ``many`` those of a column's texts.

    ``whole`` encodes a text without help.  The memo holds at most ``memo`` parts of at most 64 characters, and what the
    last call learned; when it is full the half learned first stays, as common parts come early, and the rest is learned anew.  A part
    is a word after a space, or a newline and the word after it; the first word of a text is looked up as if a newline
    stood before it, whose id is then left out.
    """

    def __init__(self, added: list[str], memo: int = 600_000):
        self._memo, self._added = memo, added
        self._known: dict[str, bytes] = {}
        self._newline = len(self.whole("\n"))
        self._marks = {c: self.whole(c) for c in ".,"}

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def _learn(self, parts: list[str]) -> None:
        self._known.update((p, self.whole(_spelled(p))) for p in parts)

    def _missing(self, new: set[str]) -> tuple[dict[str, bytes], set[str]]:
        """Learns parts that are not known yet, of one text or many.

        Returns the ids of the long ones, which are not kept, and the odd ones, whose texts must be cut otherwise.
        """
        known = self._known
        odd = new & {"", "\n"}
        # white space inside a part is rare, so it is looked for in all of them at once, the first one's head and the last one's end included
        if len(f"|{'|'.join(new)}|".replace("\n", "").split()) > 1:
            odd.update(p for p in new if _ODD.search(p.removeprefix("\n")))
        new = new - odd
        long = {p: self.whole(_spelled(p)) for p in new if len(p) > 64}
        new.difference_update(long)
        marked = [p for p in new if p[-1] in self._marks and p[-2:-1].isalpha() and p[-2] < "\x80"]  # a part ends where letters end
        new.difference_update(marked)
        new.update(q for p in marked if (q := p[:-1]) not in known)
        parts = list(new)
        for i in range(0, len(parts), 256):
            self._learn(parts[i : i + 256])
        known.update((p, known[p[:-1]] + self._marks[p[-1]]) for p in marked)
        return long, odd

    def _forget(self) -> None:
        if len(self._known) > self._memo:
            self._known = dict(islice(self._known.items(), self._memo // 2))

    def one(self, text: str | None) -> bytes:
        if not text:
            return b""
        for a in self._added:
            if a in text:
                return self.whole(text)
        self._forget()
        parts = ("\n" + text.replace("\n", " \n")).split(" ")
        known = self._known
        long, odd = self._missing({p for p in parts if p not in known})
        if odd:
            return b"".join(self._loose(text))
        return b"".join([long[p] if p in long else known[p] for p in parts] if long else map(known.__getitem__, parts))[self._newline :]

    def many(self, texts: pa.Array) -> list[bytes]:
        """What ``one`` gives for each of the texts, which should be a few megabytes together.

        Arrow cuts them and finds their different parts, so that only these are made Python strings and looked up, and
        puts the ids end to end; the library is asked at once for what is new in all of them.
        """
        texts = texts.cast(pa.large_string())
        plain = pc.greater(pc.binary_length(texts), 0).fill_null(False)
        for a in self._added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, a).fill_null(False)))
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        out = [b""] * len(texts)
        for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.one(texts[i].as_py())
        if not len(at):
            return out
        self._forget()
        empty, space, newline = (pa.scalar(x, pa.large_string()) for x in ("", " ", "\n"))
        lined = pc.binary_join_element_wise(newline, pc.replace_substring(texts.filter(plain), "\n", " \n"), empty)
        lists = pc.split_pattern(lined, " ")
        coded = lists.flatten().dictionary_encode()
        parts = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), space)[0].as_py().split(" ")
        ids = list(map(self._known.get, parts))
        holes = [i for i, x in enumerate(ids) if x is None]
        long, odd = self._missing({parts[i] for i in holes})
        known = self._known
        for i in holes:
            p = parts[i]
            ids[i] = b"" if p in odd else long[p] if p in long else known[p]
        laid = pa.array(ids, pa.large_binary()).take(coded.indices)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ends = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset :][bounds].tolist()
        raw = laid.buffers()[2] or pa.py_buffer(b"")
        for i, x, y in zip(at.tolist(), ends, ends[1:], strict=False):
            out[i] = raw[x + self._newline : y].to_pybytes()
        if odd:
            strange = np.array([p in odd for p in parts])[coded.indices.to_numpy()]
            for i in at[np.logical_or.reduceat(strange, bounds[:-1])].tolist():
                out[i] = b"".join(self._loose(texts[i].as_py()))
        return out

    def _loose(self, text: str):
        """Cuts only at spaces that a non-space follows."""
        head, *parts = re.split(r" (?=\S)", text)
        if head:
            yield self.whole(head)
        for part in parts:
            if len(part) > 64 or re.search(r"\s", part):
                yield self.whole(" " + part)
                continue
            if part not in self._known:
                self._forget()
                self._missing({part})
            yield self._known[part]


def _spelled(part: str) -> str:
    return part if part[0] == "\n" else " " + part


class Encoder(PartMemo):
    """Whole texts and unknown parts by the ``tokenizers`` library."""

    def __init__(self, path: str, memo: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        self._t.no_truncation()
        self._t.no_padding()
        vocab = self._t.get_vocab()
        newline = self._t.encode("a\na", add_special_tokens=False).tokens[1]
        space = self._t.encode("a a", add_special_tokens=False).tokens[1][0]
        self._opens = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self._opens[i] = token[0] == space or token == newline
        super().__init__([t.content for t in self._t.get_added_tokens_decoder().values()], memo)

    def whole(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def _ids(self, text: str) -> list[int]:
        return self._t.encode_batch_fast([text], add_special_tokens=False)[0].ids  # leaves out offsets, which nobody asks for

    def _learn(self, parts: list[str]) -> None:
        """Encodes parts in one call and cuts the ids where a part opens; parts hold no space and no other newline."""
        ids = np.array(self._ids("".join([p if p[0] == "\n" else " " + p for p in parts])), "<u4")
        cuts = np.flatnonzero(self._opens[ids])
        if len(cuts) != len(parts):
            super()._learn(parts)
            return
        raw, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
        at = 0
        for p, end in zip(parts, ends, strict=True):
            self._known[p] = raw[at:end]
            at = end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


KEPT.append(encoder.cache_clear)
