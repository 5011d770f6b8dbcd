"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing further columns."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def odd_documents():
    long = " ".join(f"word{i % 977} x{i}" for i in range(9000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Ünï côde 漢字 👍 \x1c\x85 token=abcdef123"), (6, long), (7, "same text here twice over and over"), (7, "same text here twice over and over"), (8, "same text here twice over and over"), (None, "no id at all"), (9, "a " * 3000), (10, "$$$ ### ***\n" * 30)]
    return [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


def documents(spark, rows=None, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents() if rows is None else rows, DOCS)
    clash = ("size", "target", "n", "key", "ids", "spans", "kept", "score", "block", "k", "shard", "row")
    return df.select("*", *(F.lit(c).alias(c) for c in clash)) if extra else df


def empty(spark):
    return spark.createDataFrame([], DOCS)
