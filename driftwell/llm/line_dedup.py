"""Lines that many documents share, dropped everywhere but in one of them; DataFrame functions only.

Hashes of line keys are range-partitioned and sorted by document and position, so the occurrences of a key in a
document stand together and its first one is told by looking at the row before.  A salt made from the document
spreads a key that very many documents hold over the ranges, and counts are summed before they are shuffled.  What
comes back for a document is a bitmap of its lines in 64-bit words, only words with a dropped line; texts are read
again when it is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SALTS = 64


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, version, dropped): for each document with dropped lines, a map from word number to 64 bits.

    ``version`` is the hash of the text, so rows that repeat an id with another text keep apart; they count as one
    document.  Rows with a null id hold no keys.
    """
    rows = written(
        df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
        .where("id is not null and length(line) >= " + str(min_chars))
        .withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), "id", "version", "pos")
    )
    salt = F.pmod(F.hash("id"), F.lit(_SALTS)).alias("salt")
    stream = Window.partitionBy("h", "g", "salt").orderBy("id", "pos")
    ranged = rows.select("*", salt).repartitionByRange(partitions(df.sparkSession), "h", "salt").sortWithinPartitions("h", "g", "salt", "id", "pos")
    first = ranged.withColumn("first", ~F.lag("id").over(stream).eqNullSafe(F.col("id")))
    # a table of its own, so that the join below shuffles both sides plainly and adaptive execution can split a hot key
    shared = written(
        first.groupBy("h", "g").agg(F.count_if("first").alias("docs"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= min_docs).select("h", "g", "keeper")
    )
    gone = rows.join(shared, ["h", "g"]).where("id < keeper")
    words = gone.groupBy("id", "version", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    )
    return words.groupBy("id", "version").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The rows of ``df``, each text without its dropped lines, and ``n_lines`` and ``n_dropped``.

    A line's key is ``line_key``; a key of at least ``min_chars`` code points that at least ``min_docs`` documents
    hold keeps its lines in the document with the largest id and loses all others.  A null text is one empty line
    (and comes back as the empty text), as an empty text is.  Ties cannot arise: ids decide, and rows with one id are
    one document.  Rows with a null id keep their lines.  Other columns come back as they are, whatever their names,
    but input columns called ``n_lines`` or ``n_dropped`` are replaced.  An empty table gives none.
    """
    maps = dropped_lines(df, id_col, text_col, min_chars, min_docs)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"))
    out = rows.join(maps, ["id", "version"], "left").withColumn("lines", _lines(F.col(f"row.`{text_col}`")))
    kept = F.when(F.col("dropped").isNull(), F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))).otherwise(F.expr(
        "array_join(filter(lines, (x, i) -> (coalesce(element_at(dropped, shiftright(i, 6)), 0L) & shiftleft(1L, i & 63)) = 0), '\n')"
    ))
    count = F.when(F.col("dropped").isNull(), 0).otherwise(F.expr("aggregate(map_values(dropped), 0, (s, x) -> s + bit_count(x))"))
    others = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in (text_col, "n_lines", "n_dropped")]
    return out.select(*others, kept.alias(text_col), F.size("lines").cast("bigint").alias("n_lines"), count.cast("bigint").alias("n_dropped")).select(
        *[c for c in df.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped"
    )
