"""Main text of pages, periodic runs, fill-in-the-middle."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from common import DOCS, LONG, TEXTS, clashing, docs

from driftwell.llm import dom_content, infilling, page_layouts, periodic, queries
from driftwell.llm.dom_tree import parse

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sql_rows(name, sf, *tables):
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        got = db.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in got.description]
        return sorted(tuple(map(str, (dict(zip(names, r))[c] for c in sorted(names)))) for r in got.fetchall())


def spark_rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


# ---- main text


@pytest.fixture(scope="module")
def model():
    return queries.page_model()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    m = dom_content.Model(rng.normal(0, 1, len(dom_content.NAMES)), rng.normal(0, 1, (dom_content.EDGES, 2, 2)))
    f = dom_content.forest([parse("<div class=ad>a<p>b</p></div><ul><li>c</ul>"), parse("<p>x y z.")])
    n = len(f.parent)
    own = np.bincount(f.node, m.weights[f.at], n)
    total, node, joint = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
    for k in range(2**n):
        y = np.array([k >> i & 1 for i in range(n)])
        p = np.exp(own[y == 1].sum() + sum(m.pairs[f.edge[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        total += p
        node[np.arange(n), y] += p
        for i in range(n):
            if f.parent[i] >= 0:
                joint[i, y[f.parent[i]], y[i]] += p
    got, pairs = m.beliefs(f)
    assert np.allclose(got, node / total) and np.allclose(pairs[f.parent >= 0], (joint / total)[f.parent >= 0])


def test_held_out_layouts(model):
    f, share = model.content([parse(p) for p in page_layouts.labelled_pages(300, 50_000)])
    want = f.label[f.leaf]
    for kind in (0, 1):
        assert ((share >= 0.5) == want)[want == kind].mean() > 0.975 and (want == kind).sum() > 1000


def test_op11_against_sql(spark, sf_dir):
    for sf in (sf_dir, "/root/testdata/sf0.01"):
        assert spark_rows(queries.op11_dom_content(spark, sf)) == sql_rows("op11_dom_content", sf, "pages")


PAGE = """<html><body><header><nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav></header>
<div class="cookie-notice">We use cookies. <button>Fine</button></div><main><article><h1>A title &amp; more</h1>
<p>First   paragraph&nbsp;with <a href=x>a link</a> and &lt;marks&gt;. It has two sentences.</p><div class="ad">Buy this now.</div>
<script>var a = "<p>no</p>";</script><p>Second paragraph, which goes on<br>after a break. One more sentence.<ul><li>An item of text.</ul></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree at all. Not at all.</p></div><form><textarea>no</textarea><button>Send</button></form></section>
</main><aside class="sidebar"><h3>More</h3><ul><li><a href=y>Other story</a></ul></aside><footer>&copy; 2024 Someone</footer></body></html>"""


def test_a_page_of_many_regions(model):
    assert dom_content.main_texts([PAGE], model) == [
        "A title & more First paragraph with a link and <marks>. It has two sentences. Second paragraph, which goes on after a break. One more sentence. An item of text."
    ]


@pytest.mark.parametrize("html, blocks", [
    (None, []), ("", []), ("plain", ["plain"]), ("<p>a<p>b<b>c<p>d</b>e", ["a", "bc", "de"]), ("a < b &amp c", ["a < b & c"]), ("<!-- x", []), ("a<!-->b<!--x-->c", ["abc"]),
    ("<script>a<b></script >c", ["c"]), ("<script>a", []), ("<p title='a>b' class=\"c", []), ("x<p title='a>b'>y", ["x", "y"]), ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<textarea>a</textarea>b", ["b"]), ("</div></p>a</b>", ["a"]), ("<b>a</i>b</b>", ["ab"]), ("<title>t</title>a", ["a"]),
    ("<head><meta charset=x>hi", ["hi"]), ("<p>a</P><DIV>b</div>", ["a", "b"]), ("a<br/>b<wbr>c", ["a bc"]), ("a &nbsp;\n b", ["a b"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
])
def test_blocks_of_markup(html, blocks):
    assert [t for t in parse(html).text if t] == blocks


def test_hostile_pages_end_soon(model):
    n = 40_000
    for html in ("<div>" * n + "x", "<b>" * n + "</i>" * n + "x", "<a href='" * n, "<!--" * n, "<" * n, "<p <" * n, "&" * n, "<div><b>" * n + "</b></div>" * n, "<a =" * n, "<li><ul>" * n + "t"):
        assert len(dom_content.main_texts([html], model)) == 1
    assert [t for t in parse("<div>" * 3000 + "deep" + "</div>" * 3000 + "out").text if t] == ["deep", "out"]


def test_extract_edges(spark, model):
    rows = [(1, "u", PAGE, "own"), (1, "u", PAGE, "own"), (None, None, None, None), (2, "v", "", "x"), (3, "w", "<article><p>" + LONG + "</article>", "x")]
    df = clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"), "n_chars", "node")
    got = {(r.page_id, r.text) for r in dom_content.extract(df, model).collect()}
    assert len(got) == 4 and (None, "") in got and (2, "") in got and (3, LONG) in got
    assert dom_content.extract(df.limit(0), model).count() == 0
    again = dom_content.extract(df.select(df.html.alias("text")), model, html_col="text")
    assert again.columns == ["text"] and again.count() == 5
    assert dom_content.fit([]).content([parse("a")])[1].tolist() == [0.5]


# ---- periodic runs


def plain_runs(words, least=24, times=3):
    found, n = {}, len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)  # smallest period first
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def cases():
    r = random.Random(5)
    yield from ([], ["a"] * 23, ["a"] * 24, ["a"] * 500, list("ab") * 12, list("ab") * 11, list("abc") * 8 + ["a", "b"], ["x"] + list("abcd") * 30 + ["y"])
    thue = [0]
    for _ in range(12):
        thue += [1 - x for x in thue]
    yield [*map(str, thue)]
    for k in range(300):
        w, letters = [], [str(i) for i in range(r.choice((1, 2, 3, 9)))]
        while len(w) < r.randint(0, 260):
            unit = r.choices(letters, k=r.randint(1, 12))
            w += unit * r.choice((1, 1, 2, 4, 7, 9)) + unit[: r.randint(0, len(unit))]
        yield w


def test_runs_against_comparison(monkeypatch):
    for words in cases():
        number = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        want = plain_runs(words) if len(words) < 4000 else []
        for pairs in (1 << 19, 7):
            monkeypatch.setattr(periodic, "_PAIRS", pairs)
            assert [*map(tuple, periodic.find_runs(ids).tolist())] == want


def test_runs_when_all_hashes_collide(monkeypatch):
    monkeypatch.setattr(periodic, "_values", lambda ids: np.zeros(len(ids), np.uint64))
    for words in list(cases())[:60]:
        if len(words) < 4000:
            number = {}
            ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
            assert {*map(tuple, periodic.find_runs(ids).tolist())} == set(plain_runs(words))


def plain_op12(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *row, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12_against_comparison(spark, sf_dir):
    short = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {plain_op12(r.doc_id, r.text) for r in short if len((r.text or "").split()) < 1500}
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert len(want) > 150 and want <= got and len(got) == len(short) and sum(r[1] > 0 for r in want) > 8


def test_runs_edges(spark, tmp_path):
    texts = [*(t for t in TEXTS if t is None or len(t) < 50_000), "go round " * 40, "    " * 30, "go round " * 40]
    d = clashing(docs(spark, texts), "runs", "row", "h", "w", "a", "p", "hit", "n_words")
    d = d.union(d.limit(0)).withColumn("doc_id", d.doc_id)
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted(plain_op12(i + 1, t) for i, t in enumerate(texts))
    planted = periodic.planted(d)
    assert planted.columns == d.columns and planted.count() == len(texts)
    null = periodic.periodic_runs(periodic.planted(spark.createDataFrame([(None, "a b " * 20)], DOCS.split(",")[0] + ", text string"))).first()
    assert null.doc_id is None and [tuple(r) for r in null.runs] == [(0, 40, 2)] and null.collapsed == "a b"
    assert periodic.periodic_runs(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(30, np.int64), times=2)


def test_a_long_loop_is_found_in_time():
    ids = np.concatenate([np.arange(1000), np.tile(np.arange(300, 360), 3000), np.arange(5000, 6000)])
    assert periodic.find_runs(ids).tolist() == [[1000, 180_000, 60]]
    assert periodic.find_runs(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]


# ---- fill-in-the-middle


def test_rope_splits_like_a_list():
    r = random.Random(2)
    for text in ["", "a", LONG[:30_000], "x" * 5000, "é<b" * 900, "".join(r.choices("ab .\n日<PSM>", k=7000))]:
        units, tree = UNIT.findall(text), infilling.rope(text)
        assert (tree.units, tree.chars, infilling.text_of(tree)) == (len(units), len(text), text)
        for k in {0, 1, 511, 512, 513, len(units) // 2, len(units)} & set(range(len(units) + 1)):
            a, b = infilling.split(tree, k)
            assert (infilling.text_of(a), infilling.text_of(b)) == ("".join(units[:k]), "".join(units[k:]))
            assert (a.units, b.units, a.chars + b.chars) == (k, len(units) - k, len(text))
        for k in {0, 1, len(text) // 3, len(text)} & set(range(len(text) + 1)):
            a, b = infilling.split(tree, k, "chars")
            assert (infilling.text_of(a), infilling.text_of(b)) == (text[:k], text[k:])


def test_round_trip_of_any_cut():
    r = random.Random(4)
    for _ in range(2000):
        text = "".join(r.choices("aB <>PSM\né", k=r.randint(0, 40)))
        h = [r.randrange(1 << 32) for _ in range(4)]
        n, form, _, _, out = infilling.rearrange(text, h)
        assert n == len(UNIT.findall(text)) and infilling.invert(out, form) == text
        assert form != "plain" or out == text


def test_op13_against_sql(spark, sf_dir, tmp_path):
    for sf in (sf_dir, "/root/testdata/sf0.01"):
        assert spark_rows(queries.op13_infilling(spark, sf)) == sql_rows("op13_infilling", sf, "documents")
    texts = [*TEXTS, "has <P> in it", "<S>", "a <M", "<" * 50]
    d = clashing(docs(spark, texts), "output", "restored", "n", "form")
    d.union(d.where("doc_id = 14")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert spark_rows(queries.op13_infilling(spark, str(tmp_path))) == sql_rows("op13_infilling", tmp_path, "documents")


def test_infilling_edges(spark):
    d = spark.createDataFrame([(None, None), (None, "some words here"), (7, "")], "doc_id bigint, text string")
    got = infilling.restore(infilling.transform(d, moved=100)).collect()
    assert [(r.form, r.restored) for r in got] == [("plain", ""), (got[1].form, "some words here"), ("plain", "")] and got[1].form != "plain"
    assert infilling.restore(infilling.transform(d.limit(0))).count() == 0
    nulls = spark.createDataFrame([(None, "a"), ("plain", None)], "form string, output string")
    assert [r.restored for r in infilling.restore(nulls).collect()] == [None, None]
