"""Texts with the cases that every operator must stand, and small helpers."""

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i * 7919 % 1009} and Word{i % 13}." for i in range(6000))
TEXTS = [
    None, "", " ", "\n\n", "a", "One two  three\tfour\nfive", "  lead and trail  ", "naïve café — ünïcödé ✓ 日本語 テスト", "x" * 9000, " " * 5000 + "end",
    "tabs\t\tand\r\nreturns \x0b\x0c", "it's we're they'll I'd", "no break space", LONG, LONG, "<|endoftext|> in a text", "emoji 👩‍👩‍👧‍👦 zero​width", "0123456789" * 700,
]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts=TEXTS, first=1):
    rows = [(first + i, t, ("en", "de", None)[i % 3], "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df, *names):
    """``df`` with columns of names that operators use inside."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("own"))
    return df


def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t
