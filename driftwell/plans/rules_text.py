"""Queries of path rules, text functions and secrets, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions import rules, secrets, text
from driftwell.plans.catalog import _FILES, _LOG, _SNAPS
from driftwell.sources import tables as t

_EXCLUDE = ["src1/en", "*/de/d1*", "src[2-4]/?r", "src5/es/d[!1-4]*.md"]
_SOME_RULES = ["*/es/", "!d*[05].md", "/src7/en", "en/d6*.md"]
_EXCLUDE_SQL = r"""(regexp_matches(rel_path, '^src1/en$|^src1/en/|^[^\n]*/de/d1|^src[2-4]/.r$|^src[2-4]/.r/|^src5/es/d[^1-4][^\n]*\.md$|^src5/es/d[^1-4][^\n]*\.md/')
  OR CASE WHEN regexp_matches(rel_path, '^(.*/|)en/d6[^/]*\.md(/.*)?$') THEN true WHEN regexp_matches(rel_path, '^src7/en(/.*)?$') THEN true
          WHEN regexp_matches(rel_path, '^(.*/|)d[^/]*[05]\.md(/.*)?$') THEN false WHEN regexp_matches(rel_path, '^(.*/|)[^/]*/es/.') THEN true ELSE false END)"""
_HOSTS = ["hooks.slack.com", "*.example.net", "M.THTHTH.example.com"]
_TEMPLATE = "{user}@{machine}: {action} {n_files} ({file_list}) first {first_file} {{{snapshot_timestamp}}}"
_NOW = "2024-01-20 06:00:00"


def _paths(s, d):
    return t.remote_files(s, d).where("rel_path is not null")


def _urls(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", "url")


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _events(s, d):
    return t.sync_events(s, d)


def _stamp(form: str):
    return F.date_format("ts", form)


def _odd_paths(s, d):
    p = F.concat("source", F.when(F.col("doc_id") % 5 == 0, "//").when(F.col("doc_id") % 5 == 1, "\\").when(F.col("doc_id") % 5 == 2, "/../").when(F.col("doc_id") % 5 == 3, "/./").otherwise("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    lead = F.when(F.col("doc_id") % 7 == 0, "/").when(F.col("doc_id") % 7 == 1, "C:").when(F.col("doc_id") % 7 == 2, "../").when(F.col("doc_id") % 7 == 3, "\\").otherwise("")
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(lead, p).alias("p"))


_ODD = r"""odd AS (SELECT doc_id, (CASE doc_id % 7 WHEN 0 THEN '/' WHEN 1 THEN 'C:' WHEN 2 THEN '../' WHEN 3 THEN '\' ELSE '' END) || source ||
  (CASE doc_id % 5 WHEN 0 THEN '//' WHEN 1 THEN '\' WHEN 2 THEN '/../' WHEN 3 THEN '/./' ELSE '/' END) || lang || '/' || doc_id AS p FROM documents)"""


def _lines_of_listing(s, d):
    i, n = F.col("doc_id"), F.col("n_chars").cast("string")
    line = (
        F.when(i % 4 == 0, F.concat(F.lit("-rw-r--r-- 1 own grp "), n, F.lit(" Jan 01 10:00 d"), i.cast("string"), F.lit(" x.md\r\n")))
        .when(i % 4 == 1, F.concat(F.lit("drwxr-xr-x 2 own grp 4096 Jan 01 10:00 f"), i.cast("string")))
        .when(i % 4 == 2, F.concat(F.lit("01-02-24  10:15AM  "), F.when(i % 8 == 2, "<DIR>").otherwise(n), F.lit("  n"), i.cast("string")))
        .otherwise(F.concat(F.lit("total "), n))
    )
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", line.alias("line"))


def _secret_texts(s, d):
    """Documents with a planted secret of each kind in turn, made of their hash."""
    h, k = F.sha2("text", 256), F.col("doc_id") % 14
    up, digits = F.upper(F.substring(h, 1, 16)), F.regexp_replace(h, "[a-f]", "7")
    made = [
        F.concat(F.lit("id AKIA"), up), F.concat(F.lit("aws_secret_access_key = '"), F.substring(h, 1, 40), F.lit("'")), F.concat(F.lit("ghp_"), F.substring(h, 1, 36)),
        F.concat(F.lit("see https://hooks.slack.com/services/T"), up, F.lit("/B"), up, F.lit("/"), F.substring(h, 1, 24)), F.concat(F.lit("xoxb-"), F.substring(digits, 1, 11), F.lit("-"), F.substring(digits, 1, 11), F.lit("-1-"), F.substring(h, 1, 24)),
        F.concat(F.lit("sk-ant-"), F.substring(h, 1, 30)), F.concat(F.lit("sk-"), F.substring(h, 1, 32)), F.concat(F.lit("AIza"), F.substring(h, 1, 35)),
        F.lit('"private_key": "-----BEGIN PRIVATE KEY-----'), F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.concat(F.lit("eyJ"), F.substring(h, 1, 12), F.lit("."), F.substring(h, 1, 12), F.lit("."), F.substring(h, 1, 12)),
        F.concat(F.lit("DB_PASSWORD = '"), F.substring(h, 1, 9), F.lit("' and api-key: \"abcdef12\"")), F.concat(F.lit("MY_CREDS: "), F.substring(h, 1, 44)), F.lit("no secret"),
    ]
    line = F.element_at(F.array(*made), (k + 1).cast("int"))
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat("text", F.lit("\nhere: "), line, F.lit(" .\nend")).alias("text"))


_PLANTED = r"""planted AS (SELECT doc_id, text || chr(10) || 'here: ' || (CASE doc_id % 14
  WHEN 0 THEN 'id AKIA' || upper(h[1:16]) WHEN 1 THEN 'aws_secret_access_key = ''' || h[1:40] || '''' WHEN 2 THEN 'ghp_' || h[1:36]
  WHEN 3 THEN 'see https://hooks.slack.com/services/T' || upper(h[1:16]) || '/B' || upper(h[1:16]) || '/' || h[1:24]
  WHEN 4 THEN 'xoxb-' || regexp_replace(h, '[a-f]', '7', 'g')[1:11] || '-' || regexp_replace(h, '[a-f]', '7', 'g')[1:11] || '-1-' || h[1:24]
  WHEN 5 THEN 'sk-ant-' || h[1:30] WHEN 6 THEN 'sk-' || h[1:32] WHEN 7 THEN 'AIza' || h[1:35] WHEN 8 THEN '"private_key": "-----BEGIN PRIVATE KEY-----'
  WHEN 9 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 10 THEN 'eyJ' || h[1:12] || '.' || h[1:12] || '.' || h[1:12]
  WHEN 11 THEN 'DB_PASSWORD = ''' || h[1:9] || ''' and api-key: "abcdef12"' WHEN 12 THEN 'MY_CREDS: ' || h[1:44] ELSE 'no secret' END) || ' .' || chr(10) || 'end' AS text
  FROM (SELECT *, sha256(text) AS h FROM documents))"""


def _kinds_sql() -> str:
    """(doc_id, line_no, kind, matched_text): of kinds that take one text of a line the first in the catalogue has it."""
    parts = []
    for k, (kind, rx) in enumerate(secrets.PATTERNS):
        group = 1 if kind in ("aws-secret-key", "password-assignment", "generic-high-entropy") else 0
        quoted = rx.replace("'", "''")
        parts.append(f"SELECT doc_id, line_no, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(line, '{quoted}', {group})) AS matched_text FROM l")
    return f"""WITH {_PLANTED}, l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) AS line_no FROM planted),
        found AS ({" UNION ALL ".join(parts)})
        SELECT doc_id, line_no::INTEGER AS line_no, kind, matched_text FROM found f WHERE k = (SELECT min(k) FROM found g WHERE g.doc_id = f.doc_id AND g.line_no = f.line_no AND g.matched_text = f.matched_text)"""


QUERIES = {
    "p01_excluded": lambda s, d: _paths(s, d).select("rel_path", rules.excluded(F.col("rel_path"), _EXCLUDE, _SOME_RULES).alias("excluded")),
    "p06_remote_scope": lambda s, d: t.remote_files(s, d).select("rel_path", rules.in_scope(F.col("rel_path"), ["src3", "src4/en"], _EXCLUDE[:1]).alias("in_scope")),
    "p07_selected": lambda s, d: _paths(s, d).where(rules.selected(F.col("rel_path"), ["src0/en/d0.md", "src1/en/d1.md", "src2/en/d2.md", "src2/en/d22.md", "nowhere"])).select("rel_path"),
    "p08_restore_match": lambda s, d: _paths(s, d).where(rules.restore_match(F.col("rel_path"), ["src1?/e[ns]/*", "src0/en/d0.md", "*/d99[!0-4].md"])).select("rel_path"),
    "p10_safe_paths": lambda s, d: _odd_paths(s, d).select("doc_id", rules.safe_path(F.col("p")).alias("safe"), rules.server_path(F.col("p")).alias("server_safe")),
    "p11_contained": lambda s, d: _odd_paths(s, d).select("doc_id", rules.contained_path("/restore", F.col("p")).alias("target")),
    "p21_sha256_names": lambda s, d: _docs(s, d).select("doc_id", rules.is_sha256(F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.upper(F.sha2("text", 256))).otherwise(F.md5("text"))).alias("is_sha256")),
    "p26_below_folder": lambda s, d: _paths(s, d).where(~rules.below_folder(F.col("rel_path"), ["de", "src9", "d5.md"])).select("rel_path"),
    "p27_hosts": lambda s, d: _urls(s, d).select("page_id", rules.host_allowed(F.regexp_extract("url", "://([^/]+)", 1), _HOSTS).alias("allowed")),
    "f31_webhook_urls": lambda s, d: _urls(s, d).select("page_id", rules.webhook_allowed(F.col("url"), "webhook").alias("generic"), rules.webhook_allowed(F.concat(F.lit("https://"), F.when(F.col("page_id") % 2 == 0, "a.").otherwise(""), F.lit("webhook.office.com/x")), "teams").alias("teams")),
    "f01_relative_dates": lambda s, d: _events(s, d).select("ord", F.date_format(text.parse_when(F.when(F.col("ord") % 4 == 0, F.concat((F.col("ord") % 50).cast("string"), F.lit("d"))).when(F.col("ord") % 4 == 1, F.concat((F.col("ord") % 9).cast("string"), F.lit("W "))).when(F.col("ord") % 4 == 2, _stamp("yyyy-MM-dd")).otherwise("soon"), F.lit(_NOW).cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("at")),
    "f02_iso_times": lambda s, d: _events(s, d).select("ord", F.date_format(text.parse_utc(F.when(F.col("ord") % 4 == 0, _stamp("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("ord") % 4 == 1, _stamp("yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(F.col("ord") % 4 == 2, _stamp("yyyy")).otherwise(_stamp("yyyy-MM-dd HH:mm:ss"))), "yyyy-MM-dd HH:mm:ss").alias("at")),
    "f03_snapshot_times": lambda s, d: _events(s, d).select("ord", F.date_format(text.snapshot_time(F.when(F.col("ord") % 3 == 0, _stamp("yyyy-MM-dd'T'HH-mm-ss'Z'")).when(F.col("ord") % 3 == 1, _stamp("yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("gone")), "yyyy-MM-dd HH:mm:ss").alias("old"), F.date_format(text.mount_time(F.when(F.col("ord") % 3 == 0, _stamp("yyyy-MM-dd'T'HH-mm-ss'Z'")).when(F.col("ord") % 3 == 1, _stamp("yyyy-MM-dd")).otherwise("gone"), F.lit(_NOW).cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("now")),
    "f06_ages": lambda s, d: _events(s, d).select("ord", text.age(F.col("ts"), F.lit(_NOW).cast("timestamp_ntz")).alias("age")),
    "f07_digests": lambda s, d: _docs(s, d).select("doc_id", text.digests(F.col("text"))[0].alias("md5"), text.digests(F.col("text"))[1].alias("sha256")),
    "f08_tags_messages": lambda s, d: _docs(s, d).select("doc_id", text.valid_tag(F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 9)).otherwise(F.substring_index("text", " ", 1))).alias("tag_ok"), text.valid_message(F.col("text")).alias("message_ok")),
    "f10_message_cells": lambda s, d: _docs(s, d).select("doc_id", text.message_cell(F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text"))).alias("cell")),
    "f12_normal_paths": lambda s, d: _odd_paths(s, d).select("doc_id", rules.normal_path(F.col("p")).alias("path"), F.array_join(rules.path_parts(F.col("p")), "|").alias("parts"), rules.base_name(F.col("p")).alias("name")),
    "f14_listing_sizes": lambda s, d: _docs(s, d).select("doc_id", text.listing_size(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, F.lit("12x"))).alias("size")),
    "f15_binary": lambda s, d: _docs(s, d).select("doc_id", text.is_binary(F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\0"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(b"\xff\xfe"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))).alias("is_binary")),
    "p20_eligible": lambda s, d: _docs(s, d).select("doc_id", text.eligible(F.when(F.col("doc_id") % 3 > 0, F.col("text").cast("binary")), F.when(F.col("doc_id") % 5 > 0, F.when(F.col("doc_id") % 7 == 0, F.lit(b"\0x")).otherwise(F.lit(b"text")))).alias("eligible")),
    "f17_findings": lambda s, d: secrets.findings(_secret_texts(s, d)).select("doc_id", "line_no", "kind", "matched_text"),
    "f19_redacted": lambda s, d: _secret_texts(s, d).select("doc_id", F.md5(secrets.redact(F.col("text"))).alias("md5")),
    "f20_file_findings": lambda s, d: secrets.findings_in_files(_secret_texts(s, d).select("doc_id", F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 4 == 0, F.lit(b"\xff")).otherwise(F.lit(b""))).alias("content"))).groupBy("kind").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("files")),
    "f21_error_texts": lambda s, d: _urls(s, d).select("page_id", text.redacted_error(F.concat(F.lit("Token x.y-"), F.col("page_id").cast("string"), F.lit(" at "), F.replace("url", F.lit("://"), F.lit("://u:p@")), F.lit("&Token=abc&b=1 in /home/own/x "), F.repeat(F.lit("z"), (F.col("page_id") % 150).cast("int"))), "/home/own").alias("error")),
    "f22_chat_texts": lambda s, d: _docs(s, d).select("doc_id", text.chat_safe(F.concat(F.col("text"), F.lit("‮*end*​<b>"))).alias("safe"), text.chat_action(F.concat(F.lit("go to HTTP://x.y/"), F.col("doc_id").cast("string"), F.lit(" or *stop*"))).alias("action")),
    "f24_templates": lambda s, d: _events(s, d).select("ord", text.rendered(_TEMPLATE, text.template_vars(F.col("files"), user=F.col("user"), machine=F.col("machine"), action=F.col("action")), F.lit("?")).alias("line"), text.rendered("{nothing}", text.template_vars(F.col("files")), F.concat(F.lit("plain "), "user")).alias("fallback")),
    "f25_template_maps": lambda s, d: _events(s, d).select("ord", F.to_json(text.rendered_all({"who": "{user}", "n": 3, "what": "{action}ed"}, text.template_vars(F.col("files"), user=F.col("user"), action=F.col("action")), F.lit(None).cast("map<string,string>"))).alias("body")),
    "f26_file_lists": lambda s, d: t.long_events(s, d).select("ord", text.shown_files(F.col("files")).alias("inline"), text.file_lines(F.col("files")).alias("lines")),
    "f27_colours": lambda s, d: _events(s, d).select("ord", text.colour(F.when(F.col("action") == "click", "push").when(F.col("action") == "view", "delete").otherwise(F.col("action"))).alias("colour")),
    "f28_summaries": lambda s, d: _events(s, d).select("ord", text.event_summary("user", "machine", "action", "files", F.lit("notes"), _stamp("yyyy-MM-dd")).alias("summary")),
    "f32_slugs": lambda s, d: _urls(s, d).select("page_id", text.project_slug(F.concat(F.lit("/a b/"), F.regexp_replace("url", "[0-9]", ""))).alias("slug")),
    "f33_envelope_names": lambda s, d: _odd_paths(s, d).select("doc_id", text.envelope_name(F.col("p")).alias("name")),
    "f35_prompt_marks": lambda s, d: _docs(s, d).select("doc_id", text.prompt_mark(F.col("doc_id") % 3, F.col("doc_id") % 2).alias("mark"), text.prompt_mark(F.col("doc_id") % 3, F.col("doc_id") % 2, True).alias("ascii")),
    "f36_list_lines": lambda s, d: _lines_of_listing(s, d).select("doc_id", text.list_line(F.col("line")).alias("e")).select("doc_id", "e.name", "e.kind", "e.size"),
    "f39_error_classes": lambda s, d: _docs(s, d).select("doc_id", text.error_class((F.col("doc_id") % 20 * 7 + 400).cast("int")).alias("class"), text.mirror_state(F.when(F.col("doc_id") % 4 > 0, text.error_class((F.col("doc_id") % 20 * 7 + 400).cast("int")))).alias("state")),
    "f41_policies": lambda s, d: _docs(s, d).select("doc_id", text.resolved("keep-remote", F.lit("mine"), F.col("text"))["winner"].alias("winner"), F.md5(text.resolved("keep-local", F.lit("mine"), F.col("text"))["content"]).alias("md5")),
    "f42_markers": lambda s, d: _docs(s, d).select("doc_id", F.md5(text.conflict_markers(F.concat("text", F.lit(" \n\n")), F.lit("other\t"))).alias("md5")),
    "f44_hrefs": lambda s, d: _urls(s, d).select("page_id", text.href_path(F.concat(F.lit("/dav/my%20notes/a%2Bb/"), F.col("page_id").cast("string"), F.lit("/")), "https://h.example/dav/my%20notes/").alias("path")),
    "f45_state_names": lambda s, d: _urls(s, d).select("page_id", text.state_name("poll:v1", F.lit("machine"), F.col("url")).alias("name")),
}

_DOCS = "FROM documents"
_LONG = f"{_LOG}, long AS (SELECT event_id AS ord, list_transform(range(1, 1 + event_id % 13), lambda i: 'f' || i) AS files FROM events)"
_SHOWN = "array_to_string(files[1:10], ', ') || CASE WHEN len(files) > 10 THEN ', and ' || (len(files) - 10) || ' more' ELSE '' END"
_SPLITS = r"(CASE doc_id % 4 WHEN 0 THEN 1 END)"
ORACLE_SQL = {
    "p01_excluded": f"WITH {_FILES} SELECT rel_path, {_EXCLUDE_SQL} AS excluded FROM remote_files",
    "p06_remote_scope": f"WITH {_FILES} SELECT rel_path, NOT (starts_with(rel_path, 'src3/') OR starts_with(rel_path, 'src4/en/') OR starts_with(rel_path, 'src1/en/')) AS in_scope FROM remote_files",
    "p07_selected": f"WITH {_FILES} SELECT rel_path FROM remote_files WHERE rel_path IN ('src0/en/d0.md', 'src1/en/d1.md', 'src2/en/d2.md', 'src2/en/d22.md', 'nowhere')",
    "p08_restore_match": f"WITH {_FILES} SELECT rel_path FROM remote_files WHERE rel_path = 'src0/en/d0.md' OR regexp_matches(rel_path, '^src1./e[ns]/|/d99[^0-4]\\.md$')",
    "p10_safe_paths": rf"""WITH {_ODD} SELECT doc_id, NOT (p[1] IN ('/', '\') OR list_contains(string_split(replace(p, '\', '/'), '/'), '..')) AS safe,
        NOT (p[1] IN ('/', '\') OR p[2] = ':' OR list_contains(string_split(replace(p, '\', '/'), '/'), '..')) AS server_safe FROM odd""",
    "p11_contained": rf"""WITH {_ODD} SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 2) THEN NULL ELSE '/restore/' ||
        CASE WHEN doc_id % 5 = 2 THEN regexp_extract(p, '/\.\./(.*)$', 1) ELSE replace(replace(p, '//', '/'), '/./', '/') END END AS target FROM odd""",
    "p21_sha256_names": f"SELECT doc_id, doc_id % 3 = 0 AND text IS NOT NULL OR doc_id % 3 = 1 AND regexp_matches(upper(sha256(text)), '^[0-9]*$') AS is_sha256 {_DOCS}",
    "p26_below_folder": f"WITH {_FILES} SELECT rel_path FROM remote_files WHERE NOT list_has_any(string_split(rel_path, '/'), ['de', 'src9', 'd5.md'])",
    "p27_hosts": "SELECT page_id, h IN ('hooks.slack.com', 'm.ththth.example.com') OR regexp_matches(h, '^.+\\.example\\.net$') AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '://([^/]+)', 1)) AS h FROM pages)",
    "f31_webhook_urls": "SELECT page_id, starts_with(url, 'https://') AS generic, page_id % 2 = 0 AS teams FROM pages",
    "f01_relative_dates": f"""WITH {_LOG} SELECT ord, strftime(CASE ord % 4 WHEN 0 THEN TIMESTAMP '{_NOW}' - to_days((ord % 50)::INT) WHEN 1 THEN TIMESTAMP '{_NOW}' - to_days((7 * (ord % 9))::INT) WHEN 2 THEN date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM log""",
    "f02_iso_times": f"WITH {_LOG} SELECT ord, strftime(CASE WHEN ord % 4 = 1 THEN ts - INTERVAL 2 HOUR WHEN ord % 4 <> 2 THEN ts END, '%Y-%m-%d %H:%M:%S') AS at FROM log",
    "f03_snapshot_times": f"""WITH {_LOG} SELECT ord, strftime(CASE WHEN ord % 3 < 2 THEN ts ELSE TIMESTAMP '1970-01-01' END, '%Y-%m-%d %H:%M:%S') AS old,
        strftime(CASE ord % 3 WHEN 0 THEN ts WHEN 1 THEN date_trunc('day', ts) ELSE TIMESTAMP '{_NOW}' END, '%Y-%m-%d %H:%M:%S') AS now FROM log""",
    "f06_ages": f"""WITH {_LOG}, a AS (SELECT ord, epoch(TIMESTAMP '{_NOW}')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM log)
        SELECT ord, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age FROM a""",
    "f07_digests": f"SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 {_DOCS}",
    "f08_tags_messages": rf"SELECT doc_id, regexp_full_match(CASE WHEN doc_id % 2 = 0 THEN text[1:9] ELSE split_part(text, ' ', 1) END, '[A-Za-z0-9._-]{{1,64}}') AS tag_ok, length(text) <= 1024 AS message_ok {_DOCS}",
    "f10_message_cells": rf"SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR text = '' THEN '—' WHEN length(m) <= 50 THEN m ELSE m[1:49] || '…' END AS cell FROM (SELECT doc_id, text, trim(regexp_replace(text, '[ \t\n\x0b\x0c\r]+', ' ', 'g')) AS m FROM documents)",
    "f12_normal_paths": rf"""WITH {_ODD} SELECT doc_id, trim(regexp_replace(p, '[/\\]+', '/', 'g'), '/') AS path, array_to_string(list_filter(string_split(p, '/'), lambda x: x <> ''), '|') AS parts, string_split(p, '/')[-1] AS name FROM odd""",
    "f14_listing_sizes": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 0 END AS size {_DOCS}",
    "f15_binary": f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN octet_length(encode(text)) < 8192 OR octet_length(encode(text)) >= 8192 AND TRY(decode(encode(text)[1:8192])) IS NULL WHEN 1 THEN true ELSE octet_length(encode(text)) > 8192 AND TRY(decode(encode(text)[1:8192])) IS NULL END AS is_binary {_DOCS}",
    "p20_eligible": f"SELECT doc_id, doc_id % 3 > 0 AND doc_id % 5 > 0 AND doc_id % 7 <> 0 AND NOT (octet_length(encode(text)) > 8192 AND TRY(decode(encode(text)[1:8192])) IS NULL) AS eligible {_DOCS}",
    "f17_findings": _kinds_sql(),
    "f19_redacted": f"""WITH planted_kinds AS ({_kinds_sql()}), {_PLANTED}, said AS (SELECT doc_id, list(struct_pack(m := matched_text, k := kind) ORDER BY length(matched_text), matched_text) AS all_ FROM (SELECT DISTINCT doc_id, matched_text, kind FROM planted_kinds) GROUP BY 1)
        SELECT doc_id, md5(coalesce(list_reduce(list_prepend(text, list_transform(all_, lambda x: x.m || chr(1) || x.k)), lambda a, x: replace(a, string_split(x, chr(1))[1], '<REDACTED:' || string_split(x, chr(1))[2] || '>')), text)) AS md5 FROM planted LEFT JOIN said USING (doc_id)""",
    "f20_file_findings": f"SELECT kind, count(*) AS findings, count(DISTINCT doc_id) AS files FROM ({_kinds_sql()}) WHERE doc_id % 4 <> 0 GROUP BY 1",
    "f21_error_texts": r"""SELECT page_id, CASE WHEN length(m) > 160 THEN m[1:159] || '…' ELSE m END AS error FROM (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(
        'Token x.y-' || page_id || ' at ' || replace(url, '://', '://u:p@') || '&Token=abc&b=1 in /home/own/x ' || repeat('z', (page_id % 150)::INT), '(?i)(Bearer|Token)\s+[A-Za-z0-9._\-]+', '\1 [redacted]', 'g'),
        '(\b[a-z][a-z0-9+.\-]*://)[^/@\s]+:[^/@\s]+@', '\1[redacted]@', 'g'), '(?i)([?&](?:access_token|token|api_key|key|secret|client_secret)=)[^&\s]+', '\1[redacted]', 'g'), '/home/own', '/$HOME') AS m FROM pages)""",
    "f22_chat_texts": rf"""SELECT doc_id, regexp_replace(text || chr(8238) || '*end*' || chr(8203) || '<b>', '[\x00-\x1f\x7f*_~`<>&|\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{2064}}\x{{2066}}-\x{{2069}}\x{{feff}}]', '', 'g') AS safe, 'go to [link removed] or stop' AS action {_DOCS}""",
    "f24_templates": f"""WITH {_LOG} SELECT ord, "user" || '@' || machine || ': ' || action || ' ' || len(files) || ' (' || {_SHOWN} || ') first ' || files[1] || ' {{unknown}}' AS line, 'plain ' || "user" AS fallback FROM log""",
    "f25_template_maps": f"""WITH {_LOG} SELECT ord, '{{"who":"' || "user" || '","n":"3","what":"' || action || 'ed"}}' AS body FROM log""",
    "f26_file_lists": f"WITH {_LONG} SELECT ord, {_SHOWN} AS inline, CASE WHEN len(files) = 0 THEN '(no files)' ELSE array_to_string(list_transform(files[1:10], lambda x: '- ' || x), chr(10)) || CASE WHEN len(files) > 10 THEN chr(10) || 'and ' || (len(files) - 10) || ' more' ELSE '' END END AS lines FROM long",
    "f27_colours": f"WITH {_LOG} SELECT ord, CASE action WHEN 'click' THEN '#22c55e' WHEN 'view' THEN '#ef4444' ELSE '#6b7280' END AS colour FROM log",
    "f28_summaries": f"""WITH {_LOG} SELECT ord, "user" || '@' || machine || ' ' || action || 'ed [' || array_to_string(files, ', ') || '] in ''notes'' at ' || strftime(ts, '%Y-%m-%d') AS summary FROM log""",
    "f32_slugs": "SELECT page_id, '%2Fa%20b%2F' || url_encode(regexp_replace(url, '[0-9]', '', 'g')) AS slug FROM pages",
    "f33_envelope_names": rf"WITH {_ODD} SELECT doc_id, replace(replace(p, '\', '/'), '/', '__') || '.merge.json' AS name FROM odd",
    "f35_prompt_marks": f"""SELECT doc_id, CASE WHEN a = 0 AND c = 0 THEN '✓' ELSE concat_ws(' ', CASE WHEN a > 0 THEN '↑' || a END, CASE WHEN c > 0 THEN '✗' || c END) END AS mark,
        CASE WHEN a = 0 AND c = 0 THEN 'ok' ELSE concat_ws(' ', CASE WHEN a > 0 THEN '+' || a END, CASE WHEN c > 0 THEN '!' || c END) END AS ascii FROM (SELECT doc_id, doc_id % 3 AS a, doc_id % 2 AS c {_DOCS})""",
    "f36_list_lines": f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'd' || doc_id || ' x.md' WHEN 1 THEN 'f' || doc_id WHEN 2 THEN 'n' || doc_id END AS name,
        CASE WHEN doc_id % 4 = 0 THEN 'file' WHEN doc_id % 4 = 1 OR doc_id % 8 = 2 THEN 'dir' WHEN doc_id % 4 = 2 THEN 'file' END AS kind,
        CASE WHEN doc_id % 4 = 0 THEN n_chars WHEN doc_id % 4 = 1 THEN 4096 WHEN doc_id % 8 = 2 THEN 0 WHEN doc_id % 4 = 2 THEN n_chars END AS size {_DOCS}""",
    "f39_error_classes": f"""SELECT doc_id, class, CASE WHEN doc_id % 4 = 0 THEN 'ok' WHEN class IN ('transient', 'unknown', 'rate_limit_global') THEN 'pending_retry' ELSE 'failed_perm' END AS state FROM (
        SELECT doc_id, CASE WHEN c = 401 THEN 'auth' WHEN c = 403 THEN 'permission' WHEN c IN (400, 404) THEN 'file_rejected' WHEN c IN (413, 507) THEN 'quota' WHEN c = 408 THEN 'transient' WHEN c = 429 THEN 'rate_limit_global' WHEN c BETWEEN 500 AND 599 THEN 'transient' ELSE 'unknown' END AS class
        FROM (SELECT doc_id, doc_id % 20 * 7 + 400 AS c {_DOCS}))""",
    "f41_policies": f"SELECT doc_id, 'remote' AS winner, md5('mine') AS md5 {_DOCS}",
    "f42_markers": rf"SELECT doc_id, md5('<<<<<<< LOCAL' || chr(10) || regexp_replace(text, '[ \t\n\x0b\x0c\r]+$', '') || chr(10) || '=======' || chr(10) || 'other' || chr(10) || '>>>>>>> REMOTE' || chr(10)) AS md5 {_DOCS}",
    "f44_hrefs": "SELECT page_id, 'a+b/' || page_id AS path FROM pages",
    "f45_state_names": "SELECT page_id, 'poll_v1_' || sha256('poll:v1' || chr(31) || 'machine' || chr(31) || url)[1:32] || '.json' AS name FROM pages",
}
