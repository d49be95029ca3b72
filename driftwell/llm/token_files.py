"""Token ids in Parquet: a list column with dictionary or delta encoding, small pages and page indexes.

Documents are dealt by ranges of their id and sorted, so files hold ascending, disjoint ranges; row groups and
pages are small, and the writer leaves column and offset indexes, so a reader that asks for a few ids, or only for
the counts, reads those pages and columns alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import binary_list, blocks
from .shared import partitions
from .tokens import encoder

#: Columns of a token file: its number and the place of a document in it, before the ids themselves.
FIELDS = "part int, first bigint, n_tokens bigint, ids array<int>"


def write_tokens(
    df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 256, files: int | None = None,
) -> None:
    """Writes the ids of each whole text, ``end_id`` appended, in ascending order of the id column.

    ``encoding`` is "dictionary" or "delta" (DELTA_BINARY_PACKED).  A null text is an empty one; rows with a null id
    come first; rows with equal ids follow one another, ordered by text.  Other columns are left out.  Beside the
    ids stand ``part`` (the file) and ``first`` (ids before the document in that file).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, enc, end = TaskContext.get().partitionId(), 0, encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in blocks(batches, 1):
            ids = [x + end for x in enc.many(b.column(1))]
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            first = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(first), pa.array(counts), binary_list(np.frombuffer(b"".join(ids), "<i4"), counts)],
                [id_col, "part", "first", "n_tokens", "ids"],
            )

    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    n = files or partitions(df.sparkSession)
    dealt = df.select(F.col(id_col), F.col(text_col)).repartitionByRange(n, F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col)
    options = {
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows, "parquet.dictionary.page.size": 1 << 20, "compression": "zstd",
    }
    dealt.mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, {FIELDS}").write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """The stored rows; only the named columns, and only pages that ``where`` may hold of, are read."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def with_starts(tokens: DataFrame) -> DataFrame:
    """Adds ``start``: all ids before the document, from the counts in the files (one total for each file)."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # A row for each file: as many as tasks wrote, however many documents there are, so one window and a broadcast will do.
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("total").over(so_far), F.lit(0)).alias("before"))
    return tokens.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def ids_crc32(tokens: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.num_columns - 1)
            raw, at = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B"), (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], [*b.schema.names[:-1], "ids_crc32"])

    kinds = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in keep)
    return tokens.select(*keep, "ids").mapInArrow(run, f"{kinds}, ids_crc32 bigint")
