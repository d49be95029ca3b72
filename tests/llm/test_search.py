"""WARC packages, classifier, suffix dedup, nearest neighbours, pipeline."""

import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from common import DOCS, LONG, TEXTS, clashing, docs

import corpus_pipeline
from driftwell.llm import classifier, nn_descent, queries, shared, simhash, suffix_dedup, warc_zip

BIG = "<html>" + "y" * 200 + "</html>"
PAGES = [(1, "http://a/1", "<p>é</p>"), (2, None, None), (3, "u", BIG), (4, "u\nv", BIG), (4, "u", BIG), (2, "w", BIG), (None, "n", BIG), (6, "s", "<p>é</p>"), (7, "", LONG), (8, "", ""), (9, "q", "a\r\n\r\nb" * 30)]


def test_warc_round_trip(spark):
    df = clashing(spark.createDataFrame(PAGES, "page_id bigint, url string, html string"), "digest", "payload", "first")
    manifest = warc_zip.write_archives(df)
    got = warc_zip.read_archives(manifest).collect()
    assert len(got) == len(PAGES)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        revisit = html == BIG and i != 2
        want.append((i, hashlib.sha256(raw).hexdigest(), len(raw), "revisit" if revisit else "response", 2 if revisit else None))
    assert sorted(((r.page_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.payload == next((h or "").encode() for i, u, h in PAGES if i == r.page_id and (h or "") == r.payload.decode()) for r in got if r.record_type == "response")
    some = warc_zip.read_archives(manifest, [3, 7]).collect()
    assert sorted(r.page_id for r in some) == [3, 7]
    for r in manifest.collect():
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:  # any ZIP reader opens a package
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED} and z.testzip() is None
            assert z.read(warc_zip.RECORDS)[:2] == b"\x1f\x8b"
    assert warc_zip.read_archives(warc_zip.write_archives(df.limit(0))).count() == 0


def package(zip64: bool) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"note PK"
        with z.open(zipfile.ZipInfo("a/ä.bin"), "w", force_zip64=zip64) as f:
            f.write(b"first member")
        z.writestr(zipfile.ZipInfo("b"), b"second")
    return out.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
def test_central_directory(zip64, monkeypatch):
    if zip64:  # the writer goes over to ZIP64 end records and extra fields
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 8)
    raw = package(zip64)
    read = lambda at, n: raw[at : at + n]
    found = warc_zip.members(read, len(raw))
    assert list(found) == ["a/ä.bin", "b"]
    assert [read(warc_zip.data_place(read, m), m.size) for m in found.values()] == [b"first member", b"second"]


def test_damaged_packages_are_told():
    with pytest.raises(ValueError):
        warc_zip.members(lambda at, n: b"no zip"[at : at + n], 6)
    with pytest.raises(ValueError):
        warc_zip.data_place(lambda at, n: b"", warc_zip.Member("x", 8, 1, 0))


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op8_classifier(spark, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    print("auc", auc, "accuracy", np.mean([(s >= 0.5) == y for s, y in held]), "recall", np.mean([s >= 0.7 for s in good]), "false", np.mean([s >= 0.7 for s in bad]))
    assert auc >= 0.9 and np.mean([s >= 0.7 for s in good]) >= 0.9


def test_classifier_edges(spark):
    d = clashing(docs(spark), "id", "label", "at", "share")
    labels = spark.createDataFrame([(1, 1), (14, 0), (5, None), (None, 1), (99, 1), (14, 0)], "doc_id bigint, quality int")
    a, b = (classifier.predict(d, classifier.fit(d, labels)).orderBy("doc_id").collect() for _ in range(2))
    assert a == b and len(a) == len(TEXTS) and all(0 <= r.score <= 1 for r in a) and a[0].score == a[1].score
    none = classifier.fit(d, labels.limit(0))
    assert all(0.4 < r.score < 0.6 for r in classifier.predict(d, none).collect())
    assert classifier.predict(spark.createDataFrame([], DOCS), none).count() == 0


def test_long_texts_are_read_in_blocks(monkeypatch):
    text = "One long text, two long texts. " * 400
    whole = classifier.features(text)
    monkeypatch.setattr(classifier, "_BLOCK", 310)
    cut = classifier.features(text)
    assert set(cut) == set(whole) and len(whole) * 0.95 < len(cut) < len(whole)
    assert len(classifier.features("x" * 1000)) > 900


def test_one_document_of_each_id_is_learned_from(spark):
    d = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other words")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    one = spark.createDataFrame([(1, "text 0"), (2, "other words")], "doc_id bigint, text string")
    assert (classifier.fit(d, labels).weights == classifier.fit(one, labels).weights).all()


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="share"):
        shared.shared_dir(Session)


def plain_repeats(rows, length=100):
    """(id, removed, spans, kept) with every window looked up."""
    order = sorted(rows, key=lambda r: r[0])
    seen, out = set(), []
    for i, t in order:
        raw, mark = (t or "").encode(), bytearray(len((t or "").encode()))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(raw)) if mark[k] and (not k or not mark[k - 1]))
        out.append((i, len(raw), sum(mark), runs, hashlib.sha256(bytes(c for c, m in zip(raw, mark, strict=True) if not m)).hexdigest()))
    return out


def repeated_texts(seed=4):
    rng = random.Random(seed)
    words = [f"w{k}{'xyzé'[k % 4]}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [say(40) for _ in range(6)]
    out = [*TEXTS]
    for _ in range(120):
        parts = [say(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 60)
            parts += [p[a : len(p) - rng.randrange(0, 60)], say(rng.randrange(0, 12))]
        out.append("".join(parts) if rng.random() < 0.5 else "\n".join(parts))
    return [*out, out[-1], "z" * 400, "ab" * 300, "q" * 99, "q" * 100, "q" * 101, say(20) + "z" * 150]


@pytest.mark.parametrize("wide", [1000, 4])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(suffix_dedup, "_WIDE", wide)
    rows = list(enumerate(repeated_texts(), 1))
    random.Random(1).shuffle(rows)
    for parts in (1, 5):
        df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts), "kept", "n_bytes", "id", "spans", "cut", "row", "gram")
        if parts == 1:
            known = suffix_dedup.wide_grams(df.selectExpr("doc_id as id", "hash(text) as version", "cast(text as binary) as text"), 100)
            assert (len(known) > 0) == (wide == 4)
        got = sorted((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup_bytes(df).collect())
        assert got == plain_repeats(rows)


def test_sketch_finds_wide_grams_in_little_space(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_KNOWN", 2000)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 20_000)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join([*(word() for _ in range(40)), passage, *(word() for _ in range(40))]).encode() for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array([0] * 400, pa.int32()), pa.array(texts, pa.binary())], ["id", "version", "text"])
    found = next(suffix_dedup._sketch(iter([batch]), 100))
    assert 0 < found.num_rows < 2000 and max(found.column("n").to_pylist()) > 300


def test_suffix_dedup_edges(spark):
    df = spark.createDataFrame([(1, LONG), (1, LONG), (None, LONG), (2, None), (3, "")], "doc_id bigint, text string")
    out = {(r.row.doc_id, r.n_removed, r.n_bytes) for r in suffix_dedup.dedup_bytes(df).collect()}
    assert (2, 0, 0) in out and (3, 0, 0) in out and all(n == b for i, n, b in out if i == 1)
    assert suffix_dedup.dedup_bytes(df.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs(spark, ["é" * 50, "x" + "é" * 50 + "y"])).collect()}
    assert texts == {1: "é" * 50, 2: "xy"}


@pytest.mark.parametrize("wide", [1000, 4])
def test_rows_that_repeat_id_and_text_are_one_document(spark, monkeypatch, wide):
    monkeypatch.setattr(suffix_dedup, "_WIDE", wide)
    kept = lambda df: sorted((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup_bytes(df).collect())
    for parts in (1, 2):
        df = spark.createDataFrame([(1, LONG), (1, LONG)], "doc_id bigint, text string").repartition(parts)
        assert kept(df) == plain_repeats([(1, LONG)]) * 2
    rows = list(enumerate(repeated_texts(), 1))
    twice = [*rows, *rows[::2], *rows[::3]]
    random.Random(2).shuffle(twice)
    want = {r[0]: r for r in plain_repeats(rows)}
    assert kept(spark.createDataFrame(twice, "doc_id bigint, text string").repartition(5)) == sorted(want[i] for i, _ in twice)


def brute_nearest(ids, x, queries_, top=5):
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in queries_:
        s = unit @ unit[ids.index(q)]
        order = sorted((k for k in range(len(ids)) if ids[k] != q), key=lambda k: (-round(s[k], 12), ids[k]))[:top]
        out[q] = [ids[k] for k in order]
    return out


def recall(rows, want):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r.vec_id)
    return np.mean([len(set(found.get(q, [])) & set(w)) / max(1, len(w)) for q, w in want.items()])


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 48))
    x = np.concatenate([centers[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 48)), rng.normal(size=(1000, 48))]).astype(np.float32)
    x[100:140] = x[100]  # copies
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist(), "own") for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<float>, node string")
    rows = nn_descent.nearest(df).collect()
    x = x.astype(np.float64)
    want = brute_nearest(ids, x, range(0, len(x), 50))
    assert {r.query_id for r in rows} == set(want) and recall(rows, want) >= 0.9
    for r in rows:
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12
    by = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id, r["rank"]))
    assert all([y[2] for y in v] == list(range(1, 6)) and v == sorted(v) for v in by.values())
    assert [y[1] for y in by[100]] == [101, 102, 103, 104, 105]


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (100, [-1.0, 0.0]), (150, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nn_descent.nearest(df).collect())
    h = round(0.5**0.5, 6)
    assert got == [(0, 1, 50, 1.0), (0, 2, 1, h), (0, 3, 100, -1.0), (50, 1, 0, 1.0), (50, 2, 1, h), (50, 3, 100, -1.0), (100, 1, 1, -h), (100, 2, 0, -1.0), (100, 3, 50, -1.0)]
    assert nn_descent.nearest(df.limit(0)).count() == 0
    assert nn_descent.nearest(df.where("vec_id = 0")).count() == 0


def isotropic(spark, n, dim, seed=2):
    """Vectors without clusters, the hardest kind."""
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))})
    unit = x.astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    near = {}
    for q in range(0, n, 50):
        s = unit @ unit[q]
        s[q] = -2
        near[q] = np.argpartition(-s, 5)[:5].tolist()
    return spark.createDataFrame(table), near


def test_rounds_of_descent_make_the_recall(spark):
    df, want = isotropic(spark, 6000, 32)
    nodes = nn_descent.nodes_of(nn_descent.usable(df), 2).cache()
    found = {}
    for rounds in (0, None):
        arcs = nn_descent.build(nodes, k=20, sample=16, block=64, rounds=rounds).where("a % 50 = 0").toPandas()
        lists = arcs.groupby("a").b.agg(set)
        found[rounds] = np.mean([len(lists[q] & set(w)) / 5 for q, w in want.items()])
    assert found[None] >= 0.85 and found[0] <= 0.4, found


def test_recall_on_fifty_thousand_vectors(spark):
    df, want = isotropic(spark, 50_000, 16)
    assert recall(nn_descent.nearest(df, k=24, sample=18).collect(), want) >= 0.9


def test_tiny_and_huge_vectors(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e-200, 1e-200]), (2, [1.0, 0.0]), (50, [1e200, 0.0]), (100, [5e-324, 1.7e308]), (3, [0.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r.vec_id, round(r.score, 9)) for r in nn_descent.nearest(df).orderBy("query_id", "rank").collect()]
    h = round(0.5**0.5, 9)
    assert got[:5] == [(0, 2, 1.0), (0, 50, 1.0), (0, 1, h), (0, 3, 0.0), (0, 100, 0.0)]
    assert got[10:] == [(100, 3, 1.0), (100, 1, h), (100, 0, 0.0), (100, 2, 0.0), (100, 50, 0.0)]


def test_pipeline_stages(spark, sf_dir):
    from test_text_rules import plain_copies, plain_lines
    from test_tokens import check_packed

    from driftwell.llm import quality_rules
    from driftwell.llm.shared import written

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "suffix-array dedup", "packing"]
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, inputs = dict(corpus_pipeline.STAGES), [d]
    for _, f in corpus_pipeline.STAGES:
        inputs.append(written(f(spark, inputs[-1], sf_dir)))
    a, b, c, e, packed = (x.collect() for x in inputs[1:])
    assert all(x.columns == d.columns for x in inputs[:-1])
    judged = quality_rules.quality(d, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r.doc_id for r in a} == {r.doc_id for r in judged.where("kept").collect()}
    assert [(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in sorted(b, key=lambda r: r.doc_id)] == [(i, h) for i, _, _, h in sorted(plain_lines([(r.doc_id, r.text) for r in a]), key=lambda r: r[0])]
    assert all(r.n_chars == len(r.text) for r in b)
    roots = plain_copies([(r.doc_id, r.text) for r in b])
    assert {r.doc_id for r in c} == set(roots)
    cut = {i: (n, s) for i, _, n, s, _ in plain_repeats([(r.doc_id, r.text) for r in c])}
    for r in e:
        before = next(x.text for x in c if x.doc_id == r.doc_id)
        assert (r.text == before) == (cut[r.doc_id][0] == 0)
    assert {r.doc_id for r in e} == {r.doc_id for r in c}
    check_packed(packed, {r.doc_id: r.text for r in e}, 1024)
    assert len(stages) == 5


def test_near_stage_keeps_null_ids_and_one_row_of_an_id(spark, sf_dir):
    a, b, c, d = ("apples fall from trees", "boats sail the sea", "cows eat grass all day", "dogs sleep near the fire")
    rows = [(None, a), (None, b), (None, b), (None, c), (5, c), (7, d), (7, d), (8, "one text of eight"), (8, "another that eight has"), (9, d), (10, "ten stands alone here")]
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], DOCS)
    kept = corpus_pipeline.near(spark, df, sf_dir)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(None, a), (None, b), (5, c), (7, d), (8, "another that eight has"), (10, "ten stands alone here")], key=repr)
    assert corpus_pipeline.near(spark, df.limit(0), sf_dir).count() == 0


def test_a_passage_in_many_chunks_is_few_rows(spark, monkeypatch):
    r = random.Random(1)
    noise = lambda n: "".join(r.choices("abcdefghij ", k=n))
    passage = noise(400)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 2_000)  # a chunk holds two or three texts
    texts = [(i, i % 7, (noise(300) + passage + noise(300)).encode()) for i in range(3000)]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts)], ["id", "version", "text"])])
    rows = pa.Table.from_batches(suffix_dedup._sample(batches(), 100, np.zeros(0, np.uint64))).to_pandas()
    first = rows[rows.role != 1]
    inside = first.groupby(["gram", "content"]).size()
    assert inside.max() == 1 and (rows.role == 1).sum() > 3000 and len(rows) == len(rows.drop_duplicates(["id", "version", "place"]))
    want = rows.sort_values(["id", "version", "place"]).groupby(["gram", "content"]).first()
    assert (first.set_index(["gram", "content"]).sort_index()[["id", "place"]] == want.sort_index()[["id", "place"]]).all().all()
    monkeypatch.setattr(suffix_dedup, "_HELD", 500)
    small = pa.Table.from_batches(suffix_dedup._sample(batches(), 100, np.zeros(0, np.uint64))).to_pandas()
    assert len(small) == len(rows) and small[small.role != 1].groupby(["gram", "content"]).size().max() < 200
    sketch = pa.Table.from_batches(suffix_dedup._sketch(batches(), 100)).to_pandas()
    assert len(sketch[sketch["n"] > 1000]) <= 12  # the grams at the passage's ends, whose surroundings differ in each text
    grams = sketch[sketch["n"] > 100]
    assert all(bin(m & (1 << 64) - 1).count("1") < 64 for m, n in zip(grams["mask"], grams["n"]) if n < 200)


def test_a_large_shard_of_near_fingerprints_is_linked_whole():
    import time

    r = random.Random(3)
    centre = r.getrandbits(64)
    near = {centre}
    while len(near) < 20_000:
        near.add(centre ^ sum(1 << r.randrange(36) for _ in range(r.randint(1, 4))) & (1 << 64) - 1)
    far = {r.getrandbits(64) for _ in range(300)}
    values = [*near, *far]
    r.shuffle(values)
    began = time.perf_counter()
    links = list(simhash._forest(values, 3))
    assert time.perf_counter() - began < 120
    assert all((values[a] ^ values[b]).bit_count() <= 3 for a, b in links)
    some = values[:1500]
    got, up = list(simhash._forest(some, 3)), list(range(1500))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(1500):
        for b in range(a):
            if (some[a] ^ some[b]).bit_count() <= 3 and top(a) != top(b):
                up[top(a)] = top(b)
    assert len(got) == 1500 - len({top(i) for i in range(1500)})
    plain = {top(i): min(j for j in range(1500) if top(j) == top(i)) for i in range(1500)}
    mine = list(range(1500))

    def above(i):
        while mine[i] != i:
            i = mine[i]
        return i

    for a, b in got:
        mine[above(a)] = above(b)
    assert len({(above(i), plain[top(i)]) for i in range(1500)}) == len({above(i) for i in range(1500)}) == len(set(plain.values()))
