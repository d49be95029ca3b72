"""A corpus pipeline: quality rules, line dedup, near-duplicates, repeated passages, packing.

``STAGES`` are run in order; each one's result is written as Parquet in the shared folder and read again as the next
one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import line_dedup, packing, quality_rules, simhash, suffix_dedup
from driftwell.llm.queries import VOCABULARY
from driftwell.llm.shared import written


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text where a stage has changed it."""
    return (docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in columns else docs).select(*columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that at least three of them share; the one with the largest id keeps them."""
    return _counted(line_dedup.dedup_lines(docs), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies (five words, similarity 0.8 or more).

    Of rows that repeat an id one stays, the least by its columns.  A row with a null id goes where a document with an id
    has its fingerprint; of other rows with null ids one of each fingerprint stays, the least by its columns.
    """
    found = simhash.near_copies(docs).where("id <=> component")
    first = written(found.select("id", F.expr("if(id is null, fp, null)").alias("fp")).groupBy("id", "fp").count())
    once, more, unnamed = (first.where(x) for x in ("id is not null and count = 1", "id is not null and count > 1", "id is null"))
    ids = lambda x: x.select(F.col("id").alias("doc_id"))
    row = F.struct(*docs.columns).alias("row")
    several = docs.join(ids(more), "doc_id", "left_semi").select(row).groupBy("row.doc_id").agg(F.min("row").alias("row"))
    null = docs.where("doc_id is null").select(row, "text")
    null = simhash.signatures(null, "row").select("fp", F.col("id").alias("row")).groupBy("fp").agg(F.min("row").alias("row")).join(unnamed, "fp", "left_semi")
    return docs.join(ids(once), "doc_id", "left_semi").select(*docs.columns).union(several.select("row.*")).union(null.select("row.*"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that start earlier in the corpus too."""
    return _counted(suffix_dedup.without_repeats(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1024, with the piece's ids and their crc32."""
    return packing.pack(docs, VOCABULARY).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality rules", rules), ("line dedup", lines), ("SimHash near-dedup", near), ("suffix-array dedup", passages), ("packing", packed)]

#: SQL has no tokenizer, no exact binomial bound and no fingerprint of this kind; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
