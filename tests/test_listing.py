"""Tree listings, sums kept up to date, rules by the thousands, small parsers: against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from driftwell.functions import rules, text
from driftwell.operators import checks, listing, rule_index, tree


def plain_listing(files, folder="", depth=None, sizes=True, times=False, ascii_only=False, root="."):
    """The listing by recursion over a tree of dictionaries."""
    last_mark, mark, gap, bar = listing.GLYPHS[ascii_only]
    top, human = {}, lambda n: f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB"
    for path, size, modified in files:
        parts, at = [p for p in path.split("/") if p], top
        for i, part in enumerate(parts):
            at = at.setdefault(part, {"#": {}, "size": 0, "modified": None})
            if i == len(parts) - 1:
                at["size"], at["modified"] = max(at["size"], size or 0), max(at["modified"] or "", modified or "")
            at = at["#"]
    for part in filter(None, folder.split("/")):
        top = top[part]["#"]
    lines, hidden, count = [root], 0, [0, 0, 0]

    def walk(node, before, level):
        nonlocal hidden
        order = sorted(node.items(), key=lambda x: (not x[1]["#"], x[0].lower(), x[0]))
        for i, (name, e) in enumerate(order):
            is_dir, is_last = bool(e["#"]), i == len(order) - 1
            count[0] += is_dir
            if not is_dir:
                count[1] += 1
                count[2] += e["size"]
            if depth is None or level <= depth:
                line = name + "/" * is_dir + (f"  {human(e['size'])}" if sizes and not is_dir else "") + (f"  {e['modified']}" if times and not is_dir and e["modified"] else "")
                lines.append(before + (last_mark if is_last else mark) + line)
            elif not is_dir:
                hidden += 1
            if is_dir:
                walk(e["#"], before + (gap if is_last else bar), level + 1)

    walk(top, "", 1)
    lines += [f"... ({hidden} more files in subtrees)"] * (hidden > 0) + ["", f"{count[0]} directories, {count[1]} files" + (f" ({human(count[2])} total)" if sizes and count[1] else "")]
    return lines


def test_listing_is_the_recursion(spark):
    r = random.Random(4)
    names = ["a", "B", "b", "ä", "Zed", "x y", "_u", ".h"]
    files = sorted({"/".join(r.choices(names, k=r.randint(1, 5))): None for _ in range(150)})
    files = [(p, r.choice((None, 0, 10, 5000)), r.choice((None, "2026-05-09"))) for p in files]
    files += [("wide/" + f"f{i}", i, None) for i in range(400)] + [("a/B", 7, "2027"), ("//a//odd/", 3, None)]
    df = spark.createDataFrame([*files, (None, 1, None)], "rel_path string, size bigint, modified string").repartition(7)
    for how in ({}, {"depth": 1}, {"depth": 3, "times": True}, {"folder": "a", "root": "a"}, {"folder": "/a/B/", "sizes": False, "ascii_only": True}, {"depth": 0}):
        got = listing.render(df, **how).collect()
        assert sorted(x.n for x in got) == list(range(len(got)))
        want = plain_listing([f for f in files if f[0].startswith(("a/", "//a")) or "folder" not in how], **how)
        assert [x.line for x in sorted(got, key=lambda x: x.n)] == want, how
    assert [x.line for x in listing.render(df.limit(0)).orderBy("n").collect()] == [".", "", "0 directories, 0 files"]
    assert [x.line for x in listing.render(df, "wide/f3").orderBy("n").collect()] == [".", "", "0 directories, 0 files"]
    with pytest.raises(FileNotFoundError):
        listing.render(df, "gone")


def test_sums_follow_changes(spark):
    r = random.Random(2)
    kinds = "rel_path string, size bigint"
    frame = lambda files: spark.createDataFrame([(p, s) for p, s in files.items()] or [], kinds)
    before = {f"{r.choice('abc')}/{r.choice('xyz')}/f{i}": r.choice((None, i, 0)) for i in range(60)}
    after = {p: s if r.random() < 0.5 else (s or 0) + 5 for p, s in before.items() if r.random() < 0.7} | {f"new/{i}": i for i in range(5)}
    want = lambda files: {(x.prefix, x["size"], x.file_count) for x in tree.rollup(frame(files)).collect()}
    changes = tree.changed_files(frame(before), frame(after))
    assert {(x.prefix, x["size"], x.file_count) for x in tree.rollup_changed(tree.rollup(frame(before)), changes).collect()} == want(after)
    gone = tree.rollup_changed(tree.rollup(frame(before)), tree.changed_files(frame(before), frame({}))).collect()
    assert [(x.prefix, x["size"], x.file_count) for x in gone] == [("", 0, 0)]
    assert changes.count() < len(before) + 5 and tree.changed_files(frame(before), frame(before)).count() == 0


def test_ten_thousand_rules_are_the_fold(spark):
    r = random.Random(9)
    parts = ["src", "docs", "a", "ab", "Build", "x.y", "n1", "n12", "long_name_of_a_folder"]
    paths = {"/".join(r.choices(parts, k=r.randint(0, 4)) + [f"f{r.randrange(300)}{r.choice(('.md', '.txt', '', '.tmp'))}"]) for _ in range(250)} | {"/lead/f1.md", "ends\n", "src/two\nlines", "[x]", "a"}
    lines = []
    for i in range(10_000):
        base = r.choice([f"f{r.randrange(3000)}.md", f"f{r.randrange(300)}?md", f"*{r.randrange(90)}.txt", "/".join(r.choices(parts, k=2)), f"**/f{r.randrange(999)}*", f"[ab]b/f{r.randrange(99)}.tmp", r.choice(parts) + str(r.randrange(500)), f"docs/**/f{r.randrange(300)}.md"])
        lines.append((i, r.choice(("", "", "!")) + r.choice(("", "", "/")) + base + r.choice(("", "", "", "/"))))
    lines += [(10_001, "# no rule"), (10_002, ""), (10_003, None), (10_004, "x" * 2000), (10_005, "[!q]"), (10_006, "end*"), (10_007, "!**/*nes"), (10_008, "[x"), (10_009, "!?")]
    compiled = [(neg, folder, re.compile(rx.removeprefix("(?d)").replace(r"\z", r"\Z"))) for _, line in lines if line is not None and (c := rules.ignore_regex(line)) for neg, folder, rx in [c]]

    def fold(path):
        out = False
        for neg, folder, rx in compiled:
            m = rx.match(path.lstrip("/"))
            if m and (not folder or m[1]):
                out = not neg
        return out

    want = {p: fold(p) for p in paths}
    df = spark.createDataFrame([(p,) for p in [*paths, *list(paths)[:5], None]], "rel_path string")
    table = spark.createDataFrame(lines, "ord bigint, line string")
    assert {x.rel_path: x.ignored for x in rule_index.many_ignored(df, table).collect()} == want and 0 < sum(want.values()) < len(want)
    few = table.where("ord % 1000 = 7")
    one = df.where("rel_path is not null").distinct().select("rel_path", rules.ignored(F.col("rel_path"), [x.line for x in few.orderBy("ord").collect()]).alias("ignored"))
    assert sorted(map(tuple, rule_index.many_ignored(df, few).collect())) == sorted(map(tuple, one.collect()))
    assert {x.ignored for x in rule_index.many_ignored(df, table.limit(0)).collect()} == {False} and rule_index.many_ignored(df.limit(0), table).count() == 0


def test_versions_sort_as_they_should(spark):
    order = ["1!0.1", "0.9", "1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0a1.post1", "1.0b", "1.0rc1", "1.0", "1.0+abc", "1.0+abc.2", "1.0+5", "1.0.post1.dev3", "1.0.post1", "1.0-2", "1.2", "v1.10"]
    order = order[1:] + order[:1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string")
    assert [x.i for x in df.orderBy(text.version_key(F.col("v"))).collect()] == list(range(len(order)))
    pairs = [("1.0", "1"), ("1.0.0", "1.0"), ("1.0", "1.0.0"), ("2.0", "1.9.9"), ("0.0.0", "0.0.0.dev1"), ("", "1"), (None, "1"), ("1.x", "1.0"), ("2", "one"), (" 1.1 ", "V1.0"), ("1.0-rc.1", "1.0.beta2"), ("1" * 30, "1")]
    got = [x[0] for x in spark.createDataFrame(pairs, "a string, b string").select(text.strictly_newer(F.col("a"), F.col("b"))).collect()]
    assert got == [False, False, False, True, False, False, False, False, False, True, True, False]


def test_what_servers_say(spark):
    h = "0123456789abcdefABCDEF0123456789"
    said = [f"213 {h}", f"213-SHA1 {h}{h} x", f"  250   :{h}:", h[:31], "", None, f"21{h}", f"{h}g {h}", "213"]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in said], "x string").select(text.hash_in_response(F.col("x"))).collect()]
    assert got == [h.lower(), (h + h).lower(), h.lower(), None, None, None, None, h.lower(), None]
    waits = [("3", None), ("soon", "4.5"), ("-1", "9"), ("", ""), (None, "1e2"), ("12d", "0x1"), (" .5 ", None), ("NaN", None), ("inf", None)]
    got = [x[0] for x in spark.createDataFrame(waits, "a string, b string").select(text.retry_after(F.col("a"), F.col("b"))).collect()]
    assert got == [3.0, 4.5, 0.0, None, 100.0, None, 0.5, 0.0, float("inf")]


def test_lines_of_backends_and_reports(spark):
    df = spark.createDataFrame([("drive", "ok", 3, 0, None), ("ftp", "pending", 0, 1, "time *out*"), ("s3", "failed", 0, 2, None), ("x", "failed", 0, 0, ""), ("y", None, 0, 0, None), ("z", "odd", 0, 0, None)], "b string, s string, n bigint, p bigint, e string")
    assert [x[0] for x in df.select(text.backend_line(*[F.col(c) for c in "bsnpe"])).collect()] == [
        "• 🟢 drive — pushed 3", "• 🟡 ftp — time out (1 file pending retry)", "• 🔴 s3 — 2 files pending retry", "• 🔴 x — failed", "• ⚪ y — unknown", "• ⚪ z — odd",
    ]
    rows = spark.createDataFrame([("a", "ok", ""), ("b", "unsupported", ""), ("c", "warn", "")], "name string, status string, detail string")
    worst = lambda *parts: {x.name: (x.status, x.detail) for x in checks.report([*parts]).collect()}["overall"]
    assert worst(rows) == ("warn", "3 checks") and worst(rows.limit(0)) == ("ok", "0 checks") and worst(rows, rows.selectExpr("name", "'fail' as status", "detail")) == ("fail", "6 checks")


def test_rules_are_filed_without_meeting_by_piece(spark, monkeypatch):
    """A piece that all rules hold gathers none of them: no exchange by piece, tasks by the number of rules; each rule is under a rarer one."""
    monkeypatch.setattr(rule_index, "ROWS_A_TASK", 10)
    lines = spark.range(60).select(F.col("id").alias("ord"), F.concat(F.lit("/src1/en/d"), (F.col("id") + 100000).cast("string"), F.lit("*.md")).alias("line"))
    found = rule_index.compiled(lines)
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString() and found.rdd.getNumPartitions() == 6
    assert sorted(r.ord for r in found.collect()) == list(range(60)) and not {"/src1/en", "src1/en/"} & {r.piece for r in found.collect()}
    monkeypatch.setattr(rule_index, "BROADCAST_BYTES", 0)
    paths = spark.createDataFrame([("src1/en/d100007x.md",), ("src1/en/d200000.md",)], "rel_path string")
    assert dict(map(tuple, rule_index.many_ignored(paths, lines).collect())) == {"src1/en/d100007x.md": True, "src1/en/d200000.md": False}
