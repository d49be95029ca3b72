"""Fill-in-the-middle: a text is cut at two unit ranks and its parts change places around sentinels.

A text is a rope: its leaves hold up to ``LEAF`` units and cache how many units and code points they have, as inner
nodes do for what is below them.  The tree is split at two unit ranks, the parts are joined again with sentinels, and
the inverse splits the tree of the output at the code-point ranks of the sentinels.  A unit is a run of the letters A to
Z in either case or one other code point.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces

LEAF = 512
#: The sentinels before prefix, suffix and middle, and the order of parts of the two forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_UNIT = re.compile(r"[A-Za-z]++|[^A-Za-z]")
_LEAVES = re.compile(rf"(?:[A-Za-z]++|[^A-Za-z]){{1,{LEAF}}}+")


@dataclass(frozen=True, slots=True)
class Leaf:
    text: str
    units: int
    chars: int


@dataclass(frozen=True, slots=True)
class Branch:
    left: Leaf | Branch
    right: Leaf | Branch
    units: int = field(init=False)
    chars: int = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "units", self.left.units + self.right.units)
        object.__setattr__(self, "chars", self.left.chars + self.right.chars)


Rope = Leaf | Branch
EMPTY = Leaf("", 0, 0)


def _leaf(text: str) -> Leaf:
    return Leaf(text, sum(1 for _ in _UNIT.finditer(text)), len(text))


def rope(text: str) -> Rope:
    """A balanced tree over the text; leaves end where units end."""
    parts = [m.group() for m in _LEAVES.finditer(text)]
    level: list[Rope] = [*(Leaf(t, LEAF, len(t)) for t in parts[:-1]), *map(_leaf, parts[-1:])]
    while len(level) > 1:
        pairs = [Branch(a, b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0] if level else EMPTY


def join(a: Rope, b: Rope) -> Rope:
    return b if not a.chars else a if not b.chars else Branch(a, b)


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first ``rank`` units (or ``chars``) and the rest; only the leaf at the cut is read."""
    left, right = EMPTY, EMPTY
    path = []
    while isinstance(tree, Branch):
        size = getattr(tree.left, by)
        path.append((tree, rank > size))
        tree, rank = (tree.right, rank - size) if rank > size else (tree.left, rank)
    if 0 < rank < getattr(tree, by):
        at = rank if by == "chars" else next(islice(_UNIT.finditer(tree.text), rank - 1, None)).end()
        left, right = _leaf(tree.text[:at]), _leaf(tree.text[at:])
    else:
        left, right = (tree, EMPTY) if rank > 0 else (EMPTY, tree)
    for node, went_right in reversed(path):
        if went_right:
            left = join(node.left, left)
        else:
            right = join(right, node.right)
    return left, right


def leaves(tree: Rope) -> Iterator[str]:
    todo = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, Branch):
            todo += [node.right, node.left]
        else:
            yield node.text


def text_of(tree: Rope) -> str:
    return "".join(leaves(tree))


def draws(doc_id: int | None, seed: str = "1") -> list[int]:
    """Four 32-bit integers from the id alone, so that a row gets the same cut in every run and place."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def rearrange(text: str, h: list[int], moved: int = 90, spm: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    tree = rope(text)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= moved:
        return tree.units, "plain", None, None, text
    low, high = sorted(x % (tree.units + 1) for x in h[:2])
    head, suffix = split(tree, high)
    prefix, middle = split(head, low)
    form = "spm" if h[3] % 100 < spm else "psm"
    parts = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    out = EMPTY
    for sentinel in FORMS[form]:
        out = join(join(out, Leaf(sentinel, 3, 3)), parts[sentinel])
    return tree.units, form, prefix.chars, middle.chars, text_of(out)


def invert(output: str, form: str) -> str:
    """The text that ``rearrange`` made ``output`` of.  No part holds a sentinel, so the first of each kind is the one put in."""
    if form == "plain":
        return output
    first, second, third = FORMS[form]
    b = output.index(second, len(first))
    c = output.index(third, b + len(second))
    parts, rest = {}, rope(output)
    for sentinel, end in ((first, b), (second, c), (third, len(output))):
        one, rest = split(rest, end - (len(output) - rest.chars), "chars")
        parts[sentinel] = split(one, len(sentinel), "chars")[1]
    return text_of(join(join(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", moved: int = 90, spm: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): each whole text cut and rearranged.

    ``moved`` of 100 texts are rearranged, ``spm`` of 100 of these with the suffix first; the others stay plain, with null
    counts, as do empty texts and texts that hold a sentinel.  A null text is an empty one; a null id draws as an empty
    string would, rows that repeat an id and a text give equal rows.  Other columns are not read; an empty table gives no
    rows.  Memory is a few times one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [rearrange(t or "", draws(i, seed), moved, spm) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*got), kinds))], [id_col, *names])

    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(df: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``df`` with the column ``restored``: the text that each output was made of, from output and form alone; null where either is null.

    A column of that name is replaced.  Outputs without the form's sentinels are an error.
    """
    columns = [c for c in df.columns if c != "restored"]
    schema = df.select(*columns).schema.add("restored", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            pairs = zip(b.column(output_col).to_pylist(), b.column(form_col).to_pylist())
            found = pa.array([None if t is None or f is None else invert(t, f) for t, f in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*columns, "restored"])

    return df.select(*columns).mapInArrow(run, schema)
