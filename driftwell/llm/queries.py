"""One query for each operator, over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, classifier, dom_content, infilling, line_dedup, nn_descent, packing, page_layouts, periodic, quality_rules, simhash, suffix_dedup, token_files,
    warc_zip,
)
from .shared import shared_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc_zip.read_archives(warc_zip.write_archives(_table(spark, sf_dir, "pages")))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, VOCABULARY)
    return token_files.ids_crc32(token_files.with_starts(token_files.read_tokens(spark, path)), ["doc_id", "start", "n_tokens"])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), F.col("component").alias("component_id"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(_table(spark, sf_dir, "documents"), VOCABULARY, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = classifier.fit(docs, labels.where(~held))
    out = classifier.predict(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(_table(spark, sf_dir, "embeddings"))


@lru_cache
def page_model() -> dom_content.Model:
    """The page model, trained once a session on the labelled layouts; it sees none of the given pages."""
    return dom_content.fit(page_layouts.labelled_pages())


def op11_dom_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dom_content.extract(_table(spark, sf_dir, "pages"), page_model())
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(periodic.planted(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "strongest.*", F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infilling.restore(infilling.transform(_table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_line_dedup, op3_warc_zip, op4_token_files, op5_simhash, op6_bpe, op7_packing, op8_classifier,
    op9_suffix_dedup, op10_nn_descent, op11_dom_content, op12_periodic_runs, op13_infilling,
)}

def _quality_sql(max_rejected: float = 0.04, error: float = 0.05) -> str:
    """SQL of op1 with the operator's defaults: statistics, the certified rule of each stratum, and the verdict."""
    places = range(quality_rules.PLACES)
    hits = ", ".join(
        "(" + " OR ".join(f"coalesce(({quality_rules.MEASURES[m][0]}) > {c}, false)" for m, c in quality_rules.joint_rule(k).items()) + f") AS hit_{k}" for k in places
    )
    counts = ", ".join(f"count(*) FILTER (good AND hit_{k}) AS good_{k}, count(*) FILTER (NOT good AND hit_{k}) AS bad_{k}" for k in places)
    tests = " UNION ALL ".join(f"SELECT s, n, bad, {k} AS k, good_{k} AS g, bad_{k} AS b FROM tested" for k in places)
    p = max_rejected
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '(null)') AS s, text, coalesce(text, '') AS x,
         list_filter(string_split_regex(coalesce(text, ''), '[	-
 ]+'), lambda v: v <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda v: regexp_matches(v, '[^	-
 ]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM docs)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY 1
), counted AS (
  SELECT doc_id, s, text, len(words) AS n_words, length(regexp_replace(x, '[	-
 ]', '', 'g')) AS word_chars,
         length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(repeats.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda v: regexp_matches(v, '[A-Z]') AND NOT regexp_matches(v, '[a-z]'))) AS n_shouted
  FROM docs LEFT JOIN repeats USING (doc_id)
), stats AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {hits} FROM counted
), marks AS (
  SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IN (0, 1) GROUP BY 1
), held AS (
  SELECT s, text, bool_or(good) AS good, {", ".join(f"bool_or(hit_{k}) AS hit_{k}" for k in places)}
  FROM stats JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY 1, 2
), tested AS (
  SELECT s, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS bad, {counts} FROM held GROUP BY 1 HAVING count(*) FILTER (good) > 0
), tails AS (
  SELECT *, CASE WHEN g >= n THEN 1 ELSE list_sum(list_transform(range(0, g + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))) END <= {error} / (SELECT count(*) FROM tested) AS proved
  FROM ({tests})
), chosen AS (
  SELECT s, CASE WHEN any_value(bad) > 0 THEN arg_max(k, b * 1000 - k) ELSE max(k) END AS k FROM tails t
  WHERE k < coalesce((SELECT min(u.k) FROM tails u WHERE u.s = t.s AND NOT u.proved), {quality_rules.PLACES}) GROUP BY 1
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(CASE k {" ".join(f"WHEN {k} THEN hit_{k}" for k in places)} END, false) AS kept
FROM stats LEFT JOIN chosen USING (s)
"""


ORACLE_SQL = {
    "op1_quality_rules": _quality_sql(),
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id < s.keeper AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op3_warc_zip": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), f AS (
  SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html
)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
""",
    # the pages of the given tables have one layout: an article element, with no other region in it
    "op11_dom_content": r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>((?s).*?)</article>', 1) AS h FROM pages
), plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(b|i|em|a)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS h FROM inner_html
), decoded AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(h, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS h FROM plain
)
SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(h, '\s+', ' ', 'g'))) AS n_chars FROM decoded
""",
    "op13_infilling": r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), cut AS (
  SELECT doc_id, x, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, x, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:n], '') AS s
  FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM parts
""",
}
