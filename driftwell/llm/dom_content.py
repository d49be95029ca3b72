"""Main text of a page by a graphical model on its tree.

Each node of the tree is content or not.  A node has a potential from its features (kind of element, what its classes
are called, lengths, links), and each parent and child share one, so that a block is judged with the part of the page it
stands in.  Sum-product messages pass up from the leaves and down again, level by level for many pages at once in numpy;
they give each block's exact marginal.  The weights maximise the likelihood of labelled pages: the gradient is the
difference between observed and expected features, and the expectation is made of the same marginals.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .dom_tree import Tree, parse

#: Elements with a weight of their own, and words in classes, ids and roles that say the same thing.
TAGS = (
    "article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th caption blockquote pre figure figcaption address"
    " header footer nav aside menu form fieldset legend button select option dialog details summary noscript body head hr center"
).split()
HINTS = {
    "navigation": "nav navbar navigation menu submenu breadcrumb breadcrumbs pager pagination tabs toc skip",
    "header": "header masthead banner topbar brand logo toolbar branding",
    "footer": "footer colophon copyright contentinfo legal imprint bottom",
    "side": "sidebar aside side rail right left column widget widgets complementary secondary",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense banner dfp teaser",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message warning privacy announcement toast dialog",
    "comment": "comment comments commentlist reply replies respond disqus discussion responses reader readers feedback",
    "form": "form search login signin signup register subscribe subscription newsletter contact mailinglist",
    "share": "share sharing social follow tweet facebook like likes buttons tools print",
    "related": "related recommended recommendations more popular trending latest similar also links archive tags tag categories",
    "content": "content article post entry story body text main articlebody maincontent page blog hentry single prose copy",
    "hidden": "hidden invisible",
}
_GROUPS = {w: g for g, words in HINTS.items() for w in words.split()}
_WORD = re.compile(r"[a-z]+")
_END = re.compile(r"[.!?…。][\"'»”)\]]*$")
LENGTHS, LINKS = (2, 4, 8, 16, 32, 64), (0.01, 0.3, 0.7)


def _ladder(name: str, steps: tuple) -> list[str]:
    return [f"{name}{i}" for i in range(len(steps) + 1)]


NAMES = [
    "element", "leaf", "tag=other", *(f"tag={t}" for t in TAGS), *(f"named={g}" for g in HINTS), "named=nothing", *(f"in={t}" for t in ("other", *TAGS)),
    *_ladder("words", LENGTHS), *_ladder("links", LINKS), "ends", "mark", "below=nothing", *_ladder("below_words", LENGTHS), *_ladder("below_links", LINKS), "below_ends",
]
INDEX = {n: i for i, n in enumerate(NAMES)}
_MARK = re.compile(r"[©®›•]")
#: Kinds of edges, by the child: a block of text, an element whose classes say something, another element.
EDGES = 3


@dataclass
class Forest:
    """Trees of some pages end to end: parents (-1 for pages), active features of node i at ``at[start[i]:start[i + 1]]``."""

    parent: np.ndarray
    page: np.ndarray
    edge: np.ndarray
    at: np.ndarray
    node: np.ndarray
    leaf: np.ndarray
    text: list[str]
    label: np.ndarray

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """Nodes below the roots by depth."""
        depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        return np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1)))[1:] if len(order) else []


def _step(name: str, steps: tuple, x: float) -> int:
    return INDEX[f"{name}{sum(x >= s for s in steps)}"]


def _groups(hint: str) -> set[str]:
    return {_GROUPS[w] for w in _WORD.findall(hint) if w in _GROUPS}


def _label(tree: Tree) -> list[int]:
    """Labels of nodes: an element's own mark or what it inherits, and no content for what stands outside every mark."""
    label = [0] * len(tree.tag)
    for i in range(1, len(label)):
        label[i] = tree.label[i] if tree.label[i] >= 0 else label[tree.parent[i]]
    return label


def forest(trees: Iterable[Tree]) -> Forest:
    parent, page, edge, at, node, leaf, text, label = [], [], [], [], [], [], [], []
    for number, t in enumerate(trees):
        base, n = len(parent), len(t.tag)
        words, linked, ends, blocks = [0] * n, [0] * n, [0] * n, [0] * n
        chars = [len(x) for x in t.text]
        own = [x.count(" ") + 1 if x else 0 for x in t.text]
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = t.parent[i]
            if not t.tag[i]:
                words[i], linked[i], ends[i], blocks[i] = own[i], min(t.linked[i], chars[i]), bool(_END.search(t.text[i])), 1
            words[p] += words[i]
            linked[p] += linked[i]
            ends[p] += ends[i]
            blocks[p] += blocks[i]
            chars[p] += chars[i]
        for i in range(n):
            active, groups = [], _groups(t.hint[i])
            if t.tag[i]:
                tag = t.tag[i] if t.tag[i] in TAGS else "other"
                active += [INDEX["element"], INDEX[f"tag={tag}"], *(INDEX[f"named={g}"] for g in groups)] + ([] if groups else [INDEX["named=nothing"]])
                if blocks[i]:
                    active += [_step("below_words", LENGTHS, words[i] / blocks[i]), _step("below_links", LINKS, linked[i] / max(1, chars[i]))]
                    active += [INDEX["below_ends"]] if 2 * ends[i] >= blocks[i] else []
                else:
                    active.append(INDEX["below=nothing"])
            else:
                above = t.tag[t.parent[i]]
                active += [INDEX["leaf"], INDEX[f"in={above if above in TAGS else 'other'}"], _step("words", LENGTHS, own[i]), _step("links", LINKS, linked[i] / max(1, chars[i]))]
                active += ([INDEX["ends"]] if ends[i] else []) + ([INDEX["mark"]] if _MARK.search(t.text[i]) else [])
                leaf.append(base + i)
                text.append(t.text[i])
            at += active
            node += [base + i] * len(active)
            edge.append(0 if not t.tag[i] else 1 if groups else 2)
        parent += [p + base if p >= 0 else -1 for p in t.parent]
        page += [number] * n
        label += _label(t)
    whole = lambda x: np.array(x, np.int64)
    return Forest(whole(parent), whole(page), whole(edge), whole(at), whole(node), whole(leaf), text, whole(label))


@dataclass
class Model:
    """A weight of each feature for "content", and of each pair (parent, child) of states for each kind of edge."""

    weights: np.ndarray
    pairs: np.ndarray

    @classmethod
    def empty(cls) -> Model:
        return cls(np.zeros(len(NAMES)), np.zeros((EDGES, 2, 2)))

    def beliefs(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of the nodes, marginals of the pairs parent and node), by passing messages up and down."""
        below = np.zeros((len(f.parent), 2))
        below[:, 1] = np.bincount(f.node, self.weights[f.at], len(f.parent))
        up = np.zeros_like(below)
        for v in reversed(f.levels):
            up[v] = np.logaddexp.reduce(self.pairs[f.edge[v]] + below[v][:, None, :], axis=2)
            for state in (0, 1):
                np.add.at(below[:, state], f.parent[v], up[v, state])
        whole, joint = below.copy(), np.zeros((len(f.parent), 2, 2))
        for v in f.levels:
            rest = whole[f.parent[v]] - up[v]
            joint[v] = self.pairs[f.edge[v]] + rest[:, :, None]
            whole[v] = below[v] + np.logaddexp.reduce(joint[v], axis=1)
            joint[v] += below[v][:, None, :]
        node = np.exp(whole - np.logaddexp.reduce(whole, axis=1, keepdims=True))
        total = np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)
        return node, np.exp(joint - total[:, None, None])

    def content(self, trees: list[Tree]) -> tuple[Forest, np.ndarray]:
        """The forest, and the marginal of "content" of each of its leaves."""
        f = forest(trees)
        return f, self.beliefs(f)[0][f.leaf, 1]


def fit(pages: Iterable[str], steps: int = 200, rate: float = 0.1, penalty: float = 1e-4) -> Model:
    """Weights of greatest likelihood for labelled pages, by gradient ascent on all of them with momentum and second moments.

    An element with the attribute ``data-label="content"`` is content with all below it, up to one with
    ``data-label="other"``, and so on; what stands outside any is not.  The pages are held in memory, so pass a bounded
    number.  Without pages all weights are 0 and every marginal is one half.
    """
    f, m = forest(map(parse, pages)), Model.empty()
    if not len(f.parent):
        return m
    child = f.parent >= 0
    size = len(f.parent)
    seen = np.bincount(f.at, f.label[f.node], len(NAMES))
    pair = np.zeros((EDGES, 2, 2))
    np.add.at(pair, (f.edge[child], f.label[f.parent[child]], f.label[child]), 1)
    x, slope, square = np.zeros(len(NAMES) + pair.size), 0.0, 0.0
    for k in range(1, steps + 1):
        m = Model(x[: len(NAMES)], x[len(NAMES) :].reshape(pair.shape))
        node, joint = m.beliefs(f)
        expected = np.zeros_like(pair)
        np.add.at(expected, f.edge[child], joint[child])
        g = np.concatenate([seen - np.bincount(f.at, node[f.node, 1], len(NAMES)), (pair - expected).ravel()]) / size - penalty * x
        slope, square = 0.9 * slope + 0.1 * g, 0.99 * square + 0.01 * g * g
        x = x + rate * (1 - k / (steps + 1)) * (slope / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-6)
    return Model(x[: len(NAMES)], x[len(NAMES) :].reshape(pair.shape))


def main_texts(htmls: list[str | None], model: Model, least: float = 0.5) -> list[str]:
    """The blocks of each page whose marginal is at least ``least``, in page order, joined by one space."""
    f, share = model.content([parse(h) for h in htmls])
    out: list[list[str]] = [[] for _ in htmls]
    for i, number in zip(np.flatnonzero(share >= least).tolist(), f.page[f.leaf[share >= least]].tolist()):
        out[number].append(f.text[i])
    return [" ".join(x) for x in out]


def extract(df: DataFrame, model: Model, html_col: str = "html", least: float = 0.5) -> DataFrame:
    """``df`` with the column ``text``, the main text of each whole page; a column of that name is replaced.

    A null or empty page, and one without a block of content, has an empty text.  Each row is looked at by itself; an
    empty table gives no rows.  White space is what Unicode calls so, no-break spaces included.  Some pages are passed
    through the model together, so that long ones are not held with many others.
    """
    columns = [c for c in df.columns if c != "text"]
    rows = df.select(*columns, F.col(html_col).alias("text"))
    known = df.sparkSession.sparkContext.broadcast((model.weights, model.pairs))  # some hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*known.value)
        for b in pieces(batches, 64):
            text = pa.array(main_texts(b.column("text").to_pylist(), m, least), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], b.schema.names)

    return rows.mapInArrow(run, rows.schema)
