"""Quality rules, line dedup, SimHash."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from common import DOCS, LONG, TEXTS, clashing, docs
from pyspark.sql import functions as F

from driftwell.llm import line_dedup, quality_rules, queries, simhash
from driftwell.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics_against_plain_ones():
    for t in [*TEXTS, "a b c d e a b c d e", "x x x x x x x", "one\none\n two\n", "## $$ a", "l\x1c\x85m n"]:
        got, want = quality_rules.text_stats(t)[:5], plain_stats(t)
        assert got == want or want[0] == 0 and got == (0,) * 5


@pytest.mark.parametrize("text", ["#   ", "\n#\n"])
def test_symbols_are_words_too(text):
    assert quality_rules.text_stats(text)[:3] == plain_stats(text)[:3]


def test_binomial_tail_is_exact():
    for n in (1, 7, 60):
        for p in (0.001, 0.04, 0.5):
            for k in range(n + 1):
                want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                assert abs(quality_rules.tail(k, n, p) - min(1, want)) < 1e-12
    assert quality_rules.tail(3, 3, 0.2) == 1.0 and quality_rules.tail(0, 0, 0.2) == 1.0


def test_rules_reject_few_good_documents_per_stratum(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_rules.quality(d, labels)
    rates = out.where("not base_failed").join(labels.where("quality = 1"), "doc_id").groupBy("lang").agg({"kept": "count", "doc_id": "count"}).count()
    assert rates == 4
    for r in out.where("not base_failed").join(labels.where("quality = 1"), "doc_id").selectExpr("lang", "int(kept) as k").groupBy("lang").avg("k").collect():
        assert r[1] >= 0.96
    assert out.count() == d.count()


def test_rules_edges(spark):
    d = clashing(docs(spark), "stats", "row", "stratum", "_text", "n_words")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = quality_rules.quality(d, none)
    assert out.count() == len(TEXTS) and all(r.kept == (not r.base_failed) for r in out.collect())
    labels = spark.createDataFrame([(None, 1), (1, None), (14, 1), (14, 1)], "doc_id bigint, quality int")
    kept = quality_rules.keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out.where("kept").collect()}
    assert quality_rules.quality(spark.createDataFrame([], DOCS), labels).count() == 0


def test_grid_cutoff_is_the_lowest_proved(spark):
    rows = [(i, "en", i, 100, 500, 30 if i < 4 else 1, 0, 0, 10, 0) for i in range(4000)]
    stats = spark.createDataFrame(rows, "doc_id bigint, lang string, _key bigint, " + ", ".join(f"{c} bigint" for c in quality_rules.STATS))
    labels = stats.selectExpr("doc_id", "1 as quality")
    found = lambda *x: {r.stratum: quality_rules.joint_rule(r.place) for r in quality_rules.calibrate(*x).collect()}
    assert found(stats, labels)["en"]["symbols"] == 0.1  # 4 of 4000 rejected at 0.1 is proved below 0.04
    assert not found(stats, labels.limit(50))
    assert not found(stats.withColumn("_key", F.col("doc_id") % 50), labels)  # 4000 copies of 50 texts are 50 trials


def test_every_stratum_is_tested_whatever_their_number(spark, monkeypatch):
    rows = [(i, None if i % 100 == 99 else f"l{i % 100}", i, 100, 500, 1, 0, 0, 10, 0) for i in range(40_000)] + [(-1, "(null)", -1, 100, 500, 90, 0, 0, 10, 0)]
    stats = spark.createDataFrame(rows, "doc_id bigint, lang string, _key bigint, " + ", ".join(f"{c} bigint" for c in quality_rules.STATS))
    labels = stats.where("doc_id >= 0").selectExpr("doc_id", "1 as quality")
    for most in (10, 1000):
        monkeypatch.setattr(quality_rules, "BROADCAST_STRATA", most)
        rules = quality_rules.calibrate(stats, labels)
        assert {r.stratum for r in rules.collect()} == {None, *(f"l{i}" for i in range(99))} and rules.first().strata == 100
        more = stats.union(stats.where("doc_id < 100").withColumn("n_symbols", F.lit(90)).withColumn("doc_id", F.col("doc_id") + 10**6))
        kept = quality_rules.judged(more, rules, "lang")
        assert kept.count() == more.count() and {r.doc_id for r in kept.where("not kept").collect()} == {10**6 + i for i in range(100)}


def test_rules_reject_bad_documents_of_each_stratum(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_rules.quality(d, labels)
    assert judged.where("not base_failed and not kept").select("lang").distinct().count() == 4
    out = judged.where("not base_failed").join(labels.where("quality = 0").select("doc_id").distinct(), "doc_id")
    rates = {r.lang: (r.bad, r.rejected) for r in out.groupBy("lang").agg(F.count("*").alias("bad"), F.count_if(~F.col("kept")).alias("rejected")).collect()}
    assert len(rates) == 4 and all(rejected >= 0.9 * bad > 0 for bad, rejected in rates.values()), rates


def test_joint_rules_are_nested():
    for k in range(1, quality_rules.PLACES):
        a, b = quality_rules.joint_rule(k - 1), quality_rules.joint_rule(k)
        assert all(a[m] >= b[m] for m in a) and a != b
    assert quality_rules.joint_rule(quality_rules.PLACES - 1) == {m: grid[0] if m != "short_words" else -4.0 for m, (_, grid) in quality_rules.MEASURES.items()}


def plain_lines(rows):
    keys = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 20:
                    keys[key(line)].add(i)
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not (i is not None and len(keys.get(key(x), ())) >= 3 and i < max(keys[key(x)]))]
        out.append((i, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_edges(spark):
    line = "A Line that is shared by documents"
    rows = [
        (1, line), (2, f"x\n {line.lower()}\t\n{line}"), (3, f"{line}\n\n"), (3, f"{line}\n\n"), (3, "other text " + line), (4, None), (5, ""), (None, line),
        (6, "ÄÖ " + line + " É\n" * 2), (7, "äÖ " + line + " É"), (8, "ÄÖ " + line + " É"), (9, "\n".join([line] * 200 + ["own"])), (10, line + "\n" + "y" * 19), (11, "y" * 19), (12, "y" * 19),
    ]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"), "line", "id", "n_lines", "version", "lines", "dropped")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "line", "id", "version", "lines", "dropped", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == plain_lines(rows)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_line_dedup_uses_no_python(spark):
    df = line_dedup.dedup_lines(docs(spark))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("name, sf_dir", [("op1_quality_rules", "/root/testdata/sf0.01"), ("op1_quality_rules", "/root/testdata/sf0.1"), ("op2_line_dedup", "/root/testdata/sf0.001"), ("op3_warc_zip", "/root/testdata/sf0.001")])
def test_sql(spark, name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf_dir).select(cols).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=3):
    least = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            least[f] = min(i, least.get(f, i))
    todo, comp = list(least), {}
    while todo:
        group, edge = [], [todo.pop()]
        while edge:
            f = edge.pop()
            group.append(f)
            near = [g for g in todo if (f ^ g).bit_count() <= radius]
            todo = [g for g in todo if g not in set(near)]
            edge += near
        m = min(least[f] for f in group)
        comp |= dict.fromkeys(group, m)
    return [comp.get(f) for f in fps]


def test_simhash_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows += spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id > 200").select("doc_id", "text").limit(400).collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(90000 + i, t) for i, t in enumerate(TEXTS)] + [(None, LONG), (None, "alone it stands"), (90000, None)]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"), "fp", "node", "id", "component")
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], fps, plain_components([i for i, _ in rows], fps), strict=True), key=repr)
    got = sorted(((r.id, r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == want


def test_links_join_all_within_the_radius(spark):
    import random

    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(300):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.choice((1, 2, 3, 4))):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp bigint, node bigint")
    roots = {r.node: r.root for r in connected_components(simhash.links(nodes)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == plain_components(range(len(fps)), fps)


def test_bk_tree_follows_edges_only_within_the_radius():
    tree = simhash.BKTree()
    values = [x * 2654435761 % (1 << 32) for x in range(500)]
    for i, v in enumerate(values):
        tree.add(v, i)
    for v in values[::50]:
        assert sorted(tree.within(v, 9)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 9]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(1, x) for x in range(2, 60)] + [(None, 3), (7, 7), (300, 299), (300, 299)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(100, 165), 100), **dict.fromkeys(range(1, 60), 1), 299: 299, 300: 299}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_copies(rows, share=0.8):
    """(id, component) by an exact join: equal sets of five-word shingles, or a Jaccard similarity of at least ``share``."""
    sets, least = [], {}
    for i, t in rows:
        words = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))) if words else frozenset())
        if i is not None:
            least[sets[-1]] = min(i, least.get(sets[-1], i))
    texts = list(least)
    up = {i: i for i, _ in rows if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    def join(a, b):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)

    where = {}
    for n, s in enumerate(texts):
        for g in s:
            where.setdefault(g, []).append(n)
    for n, s in enumerate(texts):
        both = {}
        for g in s:
            for m in where[g]:
                if m < n:
                    both[m] = both.get(m, 0) + 1
        for m, c in both.items():
            if c >= share * (len(s) + len(texts[m]) - c) - 1e-9:
                join(least[s], least[texts[m]])
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None:
            join(i, least[s])
    return [top(least[s]) if s in least else None for s in sets]


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), changes):
            words[at] = f"other{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [1000, 4])
def test_near_copies_against_an_exact_join(spark, block):
    import random

    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(90000 + i, t) for i, t in enumerate(TEXTS)] + [(None, LONG), (None, "alone it stands"), (90000, None), (90010, "a second text of one id")]
    at = 95000
    for words, changes in ((300, 4), (120, 2), (80, 1), (2000, 30)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for t in variants(rng, base, 12, changes):
            rows.append((at, t))
            at += 1
    passage = " ".join(f"shared{i}" for i in range(120))
    rows += [(at + i, passage + " " + " ".join(f"own{i}x{j}" for j in range(100))) for i in range(30)]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"), "fp", "node", "id", "component", "keys", "grams", "hot")
    want = sorted(zip([i for i, _ in rows], plain_copies(rows), strict=True), key=repr)
    got = sorted(((r.id, r.component) for r in simhash.near_copies(df, block=block).collect()), key=repr)
    assert got == want
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_near_copies_keep_chains_in_large_shards(spark):
    """One passage in every text, and a chain in which only neighbours are alike, dealt over many small parts."""
    words = [f"w{i}" for i in range(600)]
    chain = [" ".join(words[12 * i : 12 * i + 250]) for i in range(25)]
    passage = " ".join(f"shared{i}" for i in range(400))
    alone = [passage + " " + " ".join(f"own{i}x{j}" for j in range(400)) for i in range(60)]
    rows = list(enumerate(chain + alone))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = list(zip(range(len(rows)), plain_copies(rows), strict=True))
    assert [c for _, c in want[:25]] == [0] * 25 and [c for _, c in want[25:]] == list(range(25, 85))
    for block in (3, 1000):
        assert sorted((r.id, r.component) for r in simhash.near_copies(df, block=block).collect()) == want
