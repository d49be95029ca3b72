"""Queries of tree listings, sums kept up to date, rules by the thousands, and small parsers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions import text
from driftwell.operators import checks, listing, mirrors, rule_index, tree
from driftwell.plans.catalog import _FILES, _LOG
from driftwell.sources import tables as t


def _resized(s, d):
    """The remote files with other sizes for some: what comes after the local ones."""
    return t.remote_files(s, d).select("rel_path", F.when(F.col("rel_path").endswith("3.md"), F.col("size") * 2).otherwise(F.col("size")).alias("size"))


def _rules(s, d):
    """(ord, line): some thousands of ignore rules of five kinds, made of parts."""
    k = F.col("p_partkey")
    n, seven = k.cast("string"), (k % 7).cast("string")
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("d"), n, F.lit(".md"))).when(k % 5 == 1, F.concat(F.lit("!/src"), (k % 5).cast("string"), F.lit("/en/d"), n, F.lit("*.md")))
        .when(k % 5 == 2, F.concat(F.lit("d"), n, F.lit("?.md"))).when(k % 5 == 3, F.concat(F.lit("src"), seven, F.lit("/de/d"), n, F.lit(".md")))
        .when(k == 4, "/src1/es/").otherwise(F.concat(F.lit("# "), n))
    )
    return s.read.parquet(f"{d}/part.parquet").select(k.alias("ord"), line.alias("line"))


def _answers(s, d):
    """(doc_id, answer, header, other): texts that servers say."""
    i, h = F.col("doc_id"), F.md5("text")
    answer = (
        F.when(i % 6 == 0, F.concat(F.lit("213 "), F.upper(h))).when(i % 6 == 1, F.concat(F.lit(" 250-SHA256: "), h, h, F.lit(" file.md")))
        .when(i % 6 == 2, F.concat(F.lit("hash "), F.substring(h, 1, 31))).when(i % 6 == 3, F.concat(F.lit("213-"), h)).when(i % 6 == 4, "").otherwise(F.concat(F.lit("is :"), h, F.lit(": or "), F.reverse(h)))
    )
    header = F.when(i % 7 == 0, "120").when(i % 7 == 1, " 1.5 ").when(i % 7 == 2, "-3").when(i % 7 == 3, "Wed, 21 Oct 2026 07:28:00 GMT").when(i % 7 == 4, "").when(i % 7 == 5, "12d")
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", answer.alias("answer"), header.alias("header"), F.when(i % 3 == 0, i.cast("string")).alias("other"))


def _version(i):
    middle = F.when(i % 4 == 0, ".0").when(i % 4 == 1, "a1").otherwise("")
    return F.concat((i % 3).cast("string"), F.lit("."), (i % 11).cast("string"), middle, F.when(i % 5 == 0, ".post2").otherwise(""), F.when(i % 4 == 2, ".dev3").otherwise(""))


def _health(s, d):
    audit = mirrors.backend_status(t.manifest_remotes(s, d))
    rung = F.when(F.col("status") == "failed", "fail").when(F.col("status") == "pending", "warn").otherwise("ok")
    rows = audit.select(F.concat(F.lit("mirror_"), "backend").alias("name"), rung.alias("status"), F.concat(F.col("failed").cast("string"), F.lit(" given up, "), F.col("pending").cast("string"), F.lit(" waiting")).alias("detail"))
    age = checks.last_sync_age(t.sync_events(s, d), F.lit("2024-02-01 12:00:00")).select("name", "status", F.lit("").alias("detail"))
    return checks.report([rows, age, rows.limit(0).union(s.range(1).select(F.lit("watcher_running"), F.lit("unsupported"), F.lit("")))])


QUERIES = {
    "n06_tree_lines": lambda s, d: listing.render(t.remote_files(s, d)),
    "n06_tree_levels": lambda s, d: listing.render(t.remote_files(s, d), depth=2, sizes=False, ascii_only=True),
    "n06_tree_folder": lambda s, d: listing.render(t.remote_files(s, d), "src1", root="src1"),
    "a07_rollup_changed": lambda s, d: tree.rollup_changed(tree.rollup(t.local_files(s, d)), tree.changed_files(t.local_files(s, d), _resized(s, d))),
    "j17_many_rules": lambda s, d: rule_index.many_ignored(t.remote_files(s, d), _rules(s, d)),
    "f37_answers": lambda s, d: _answers(s, d).select("doc_id", text.hash_in_response(F.col("answer")).alias("hash")),
    "f38_retry_after": lambda s, d: _answers(s, d).select("doc_id", text.retry_after(F.col("header"), F.col("other")).alias("seconds")),
    "f30_newer": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", text.strictly_newer(_version(F.col("doc_id")), _version(F.expr("doc_id div 7"))).alias("newer")),
    "a21_health_report": _health,
    "f43_backend_lines": lambda s, d: mirrors.backend_status(t.manifest_remotes(s, d)).select("backend", text.backend_line(F.col("backend"), F.col("status"), F.col("ok"), F.col("pending"), F.col("last_error")).alias("line")),
}

_ENTRIES = """
paths AS (SELECT list_filter(string_split(rel_path, '/'), lambda x: x <> '') AS p, max(coalesce(size, 0)) AS size FROM remote_files GROUP BY 1),
each AS (SELECT p[1:i] AS parts, i < len(p) AS is_dir, size FROM paths, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)),
known AS (SELECT parts, bool_or(is_dir) AS is_dir, max(size) FILTER (NOT is_dir) AS size, len(parts) AS level FROM each GROUP BY 1),
sorted AS (SELECT *, list_transform(parts, lambda x, i: {'file': NOT is_dir AND i = level, 'lower': lower(x), 'name': x}) AS key, parts[1:level - 1] AS parent FROM known)"""
_HUMAN = """CASE WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN printf('%.1f KB', {0} / 1024) WHEN {0} < 1073741824 THEN printf('%.1f MB', {0} / 1048576) ELSE printf('%.1f GB', {0} / 1073741824) END"""


def _tree_sql(where: str, level: int, depth: int | None, sizes: bool, glyphs: tuple, root: str) -> str:
    """The listing of what ``where`` takes, whose names start ``level`` levels down."""
    last, mark, gap, bar = glyphs
    size = "'  ' || " + _HUMAN.format("size") if sizes else "''"
    total = f"|| CASE WHEN files > 0 THEN ' (' || {_HUMAN.format('bytes')} || ' total)' ELSE '' END" if sizes else ""
    shown = "true" if depth is None else f"level - {level} <= {depth}"
    return f"""WITH {_FILES}, {_ENTRIES}, below AS (SELECT * FROM sorted WHERE level > {level} AND {where}),
    shown AS (SELECT *, row_number() OVER (ORDER BY key) AS n FROM below WHERE {shown}),
    marked AS (SELECT *, n = max(n) OVER (PARTITION BY parent) AS is_last FROM shown),
    signs AS (SELECT parts, level AS at, CASE WHEN is_last THEN '{gap}' ELSE '{bar}' END AS sign FROM marked WHERE is_dir),
    lines AS (SELECT m.n, any_value(m.is_last) AS is_last, any_value(m.parts[-1] || CASE WHEN m.is_dir THEN '/' ELSE {size} END) AS label, coalesce(string_agg(s.sign, '' ORDER BY s.at), '') AS before
      FROM marked m LEFT JOIN signs s ON s.at < m.level AND m.parts[1:s.at] = s.parts GROUP BY 1),
    about AS (SELECT count(*) FILTER (is_dir) AS dirs, count(*) FILTER (NOT is_dir) AS files, coalesce(sum(size) FILTER (NOT is_dir), 0)::BIGINT AS bytes,
      count(*) FILTER (NOT is_dir AND NOT {shown}) AS hidden, count(*) FILTER ({shown}) AS listed FROM below)
    SELECT 0::BIGINT AS n, '{root}' AS line UNION ALL SELECT n, before || CASE WHEN is_last THEN '{last}' ELSE '{mark}' END || label FROM lines
    UNION ALL SELECT listed + 1, '... (' || hidden || ' more files in subtrees)' FROM about WHERE hidden > 0
    UNION ALL SELECT listed + 1 + (hidden > 0)::INT, '' FROM about
    UNION ALL SELECT listed + 2 + (hidden > 0)::INT, dirs || ' directories, ' || files || ' files' {total} FROM about"""


_VERSIONS = """(SELECT doc_id, side, [i % 3, CASE WHEN i % 4 = 0 AND i % 11 = 0 THEN 0 ELSE i % 11 END, CASE i % 4 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN i % 5 = 0 THEN 4 ELSE 0 END ELSE 4 END,
  CASE WHEN i % 4 = 1 THEN 1 ELSE 0 END, CASE WHEN i % 5 = 0 THEN 2 ELSE -1 END, CASE WHEN i % 4 = 2 THEN 3 ELSE 1000000 END] AS k
  FROM documents, LATERAL (SELECT * FROM (VALUES (0, doc_id), (1, doc_id // 7)) v(side, i)) x)"""

ORACLE_SQL = {
    "n06_tree_lines": _tree_sql("true", 0, None, True, listing.GLYPHS[False], "."),
    "n06_tree_levels": _tree_sql("true", 0, 2, False, listing.GLYPHS[True], "."),
    "n06_tree_folder": _tree_sql("parts[1] = 'src1'", 1, None, True, listing.GLYPHS[False], "src1"),
    "a07_rollup_changed": f"""WITH {_FILES}, after AS (SELECT rel_path, CASE WHEN rel_path LIKE '%3.md' THEN size * 2 ELSE size END AS size FROM remote_files)
        SELECT array_to_string(p[1:i], '/') AS prefix, sum(coalesce(size, 0))::BIGINT AS size, count(*) AS file_count
        FROM (SELECT string_split(rel_path, '/') AS p, size FROM after), LATERAL (SELECT unnest(range(0, len(p) + 1)) AS i) GROUP BY 1""",
    "j17_many_rules": f"""WITH {_FILES}, asked AS (SELECT rel_path, split_part(rel_path, '/', 1) AS folder, split_part(rel_path, '/', 2) AS lang, split_part(rel_path, '/', 3) AS name FROM remote_files),
        hits AS (SELECT rel_path, arg_max(p_partkey % 5 <> 1, p_partkey) AS ignored FROM asked, (SELECT p_partkey, 'd' || p_partkey AS d, p_partkey % 7 AS seven FROM part) WHERE CASE p_partkey % 5
          WHEN 0 THEN name = d || '.md' WHEN 1 THEN folder = 'src1' AND lang = 'en' AND starts_with(name, d) WHEN 2 THEN starts_with(name, d) AND length(name) = length(d) + 4
          WHEN 3 THEN folder = 'src' || seven AND lang = 'de' AND name = d || '.md' ELSE p_partkey = 4 AND folder = 'src1' AND lang = 'es' END GROUP BY 1)
        SELECT rel_path, coalesce(ignored, false) AS ignored FROM asked LEFT JOIN hits USING (rel_path)""",
    "f37_answers": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN md5(text) WHEN 1 THEN md5(text) || md5(text) WHEN 3 THEN md5(text) WHEN 5 THEN md5(text) END AS hash FROM documents",
    "f38_retry_after": """SELECT doc_id, coalesce(CASE doc_id % 7 WHEN 0 THEN 120.0 WHEN 1 THEN 1.5 WHEN 2 THEN 0.0 END, CASE WHEN doc_id % 3 = 0 THEN doc_id END)::DOUBLE AS seconds FROM documents""",
    "f30_newer": f"SELECT a.doc_id, a.k > b.k AS newer FROM {_VERSIONS} a JOIN {_VERSIONS} b ON a.doc_id = b.doc_id AND a.side = 0 AND b.side = 1",
    "a21_health_report": f"""WITH {_FILES}, {_LOG}, checked AS (SELECT 'mirror_' || backend AS name, CASE WHEN count(*) FILTER (state = 'failed_perm') > 0 THEN 'fail' WHEN count(*) FILTER (state = 'pending_retry') > 0 THEN 'warn' ELSE 'ok' END AS status,
          count(*) FILTER (state = 'failed_perm') || ' given up, ' || count(*) FILTER (state = 'pending_retry') || ' waiting' AS detail FROM remotes GROUP BY backend
        UNION ALL SELECT 'last_sync_age', CASE WHEN h > 72 THEN 'fail' WHEN h > 24 THEN 'warn' ELSE 'ok' END, '' FROM (SELECT date_diff('second', arg_max(ts, ord), TIMESTAMP '2024-02-01 12:00:00') / 3600 AS h FROM log)
        UNION ALL SELECT 'watcher_running', 'unsupported', '')
        SELECT * FROM checked UNION ALL SELECT 'overall', CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'ok' END, count(*) || ' checks' FROM checked""",
    "f43_backend_lines": f"""WITH {_FILES}, b AS (SELECT backend, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'pending_retry') AS pending, count(*) FILTER (state = 'failed_perm') AS failed,
          arg_max(last_error, ord) FILTER (last_error <> '') AS e FROM remotes GROUP BY 1)
        SELECT backend, '• ' || CASE WHEN failed > 0 THEN '🔴' WHEN pending > 0 THEN '🟡' ELSE '🟢' END || ' ' || backend || ' — ' || CASE WHEN failed + pending = 0 THEN 'pushed ' || ok
          ELSE e || CASE WHEN pending > 0 THEN ' (' || pending || CASE WHEN pending = 1 THEN ' file' ELSE ' files' END || ' pending retry)' ELSE '' END END AS line FROM b""",
}
