"""A supervised subword classifier: hashed n-gram vectors, averaged per document, with a softmax on top.

A document's features are hashed words, pairs of neighbouring words, pairs of their shapes, and character 3- and
4-grams, of the whole text.  Each has a learned vector; their mean goes to a linear softmax.  Both are trained
together by stochastic gradient descent in numpy.  As mean and softmax are linear up to the last step, a document's
log-odds are the mean of one number per feature, and scoring is one look-up in a small table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces

BUCKETS = 1 << 16
#: Bytes of a text that are turned into features at once; a longer text takes no more memory.
_BLOCK = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _M2
    return (x ^ x >> np.uint64(29)) * _M1 >> np.uint64(64 - 16)


_POWERS = np.array([pow(int(_M1), i, 1 << 64) for i in range(64)], np.uint64)
#: What a byte counts as in a word's shape: upper case, lower case or other letter, digit, mark.
_SHAPE = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b > 127 else 3 if 48 <= b <= 57 else 4 + b % 29 for b in range(256)], np.uint64)


def features(text: str | None) -> np.ndarray:
    """Bucket numbers of a text's features, repeats included; none for a null or empty text."""
    found = [*_features((text or "").encode())]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _features(raw: bytes) -> Iterator[np.ndarray]:
    """Features of a text in blocks of at most ``_BLOCK`` bytes, cut after white space where there is any: n-grams and pairs do not cross a cut."""
    at = 0
    while at < len(raw):
        end = at + _BLOCK
        if end < len(raw):
            end = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t")) + 1 or end
        yield _block_features(raw[at:end])
        at = end


def _block_features(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    x = b.astype(np.uint64)
    out = []
    if len(b) >= 3:
        tri = x[:-2] | x[1:-1] << np.uint64(8) | x[2:] << np.uint64(16)
        out.append(_mix(tri + np.uint64(1 << 40)))
        if len(b) >= 4:
            out.append(_mix((tri[:-1] | x[3:] << np.uint64(24)) + np.uint64(2 << 40)))
    inside = np.concatenate([[False], ~((b == 32) | (b >= 9) & (b <= 13)), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        place = np.arange(len(b))
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(b))))
        weight = np.where(inside[1:-1], _POWERS[place & 63], np.uint64(0))
        word = np.add.reduceat((x + np.uint64(1)) * weight, starts)
        shape = (_SHAPE[b[starts]] << np.uint64(12)) | (_SHAPE[b[np.minimum(starts + 1, ends - 1)]] << np.uint64(6)) | _SHAPE[b[ends - 1]]
        out.append(_mix(word + np.uint64(3 << 40)))
        if len(word) > 1:
            same = (word[1:] == word[:-1]).astype(np.uint64)
            out.append(_mix(word[:-1] * _M2 + word[1:] + np.uint64(4 << 40)))
            out.append(_mix(((shape[:-1] << np.uint64(20)) | (shape[1:] << np.uint64(1)) | same) + np.uint64(5 << 44)))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    """One number per bucket and a bias: log-odds of label 1 are the mean over a document's features plus the bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for f in _features((text or "").encode()):
            total, n = total + float(self.weights[f].sum()), n + len(f)
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 12, epochs: int = 12, rate: float = 1.5, seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, their shares of the document, label), one document a step."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    top, bias = rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, share, label = rows[i]
            lr = np.float32(rate * (1 - steps / total))
            steps += 1
            mean = share @ vectors[at] if len(at) else np.zeros(dim, np.float32)
            z = mean @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            down = top @ p
            top -= lr * np.float32(0.2) * np.outer(mean, p)
            bias -= lr * np.float32(0.2) * p
            if len(at):
                vectors[at] -= lr * np.float32(20) * np.outer(share, down)
    return Model((vectors @ (top[:, 1] - top[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(
    df: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how
) -> Model:
    """Trains on the whole texts of at most ``sample`` labelled rows, those with the smallest hash of their id.

    What comes to the driver is, for each of them, its distinct buckets (``BUCKETS`` at most) and their shares, and the
    label.  Rows with a null id or label are left out; a label other than 0 counts as 1; of documents that repeat an id
    the least text is taken.  With no rows the model scores everything 0.5.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    )
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            at, share = [], []
            for t in b.column(1).to_pylist():
                counts = np.zeros(BUCKETS, np.int64)
                for f in _features((t or "").encode()):
                    counts += np.bincount(f, minlength=BUCKETS)
                f = np.flatnonzero(counts)
                n = counts[f]
                at.append(f.astype("<u2").tobytes())
                share.append((n / max(1, n.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["id", "label", "at", "share"])

    kind = df.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, label int, at binary, share binary").toArrow().sort_by("id").to_pylist()
    return train([(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["share"], "<f4"), r["label"]) for r in got], **how)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the chance of label 1 of each whole text; only the text is an input.

    A null or empty text has the model's bias alone.  Each row is scored by itself, whatever its id; other columns are
    not read; an empty table gives no rows.
    """
    weights = df.sparkSession.sparkContext.broadcast(model.weights)  # BUCKETS numbers
    bias = model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights.value, bias)
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in b.column(1).to_pylist()], pa.float64())], [id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, score double")
