"""Shared small tables: driver documents, and rows that strain an operator."""

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: Columns that operators use inside; an input may have them, too.
CLASHING = ["key", "row", "bytes", "_key", "items", "n", "word", "fp", "id", "spans", "Score", "rare", "input_0", "chosen"]

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())]
                      + [T.StructField(c, T.StringType()) for c in CLASHING])


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sentence(rng, n):
    return " ".join(rng.choice("the of and river stone quiet morning letter garden winter".split()) for _ in range(n))


def edge_rows():
    """(doc_id, text, lang, source, n_chars): nulls in every column, empty,
    blank and very long texts, ties, repeated rows, text beyond ASCII."""
    rng = random.Random(11)
    shared = sentence(rng, 60)
    long_text = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\r ", "en", None, 5), (4, "x", None, "b", 1),
            (5, shared, "en", "a", None), (6, shared, "en", "b", 1), (7, shared + " end", "de", "a", 1),
            (7, shared + " end", "de", "a", 1), (None, shared + " other end", None, None, None),
            (None, None, None, None, None), (8, long_text, "en", "c", 1), (9, "ÉTÉ à  la plage\n\nété ß 日本 \U0001f600", "fr", "c", 3),
            (10, "1234 5678 !!", "en", "c", 2), (11, "a" * 1000, "en", "b", 9), (12, "ab " * 500, "fr", "b", 9),
            (13, "A.\nA.\nA.\n", "fr", "é", 9), (14, "nul \x00 byte", "en", "a", 1)]
    rows += [(20 + i, sentence(rng, 20 + i), "en", "a", 1) for i in range(10)]
    rows += [(40 + i, "le la les des une " + sentence(rng, 30).replace("the", "dans"), "fr", "b", 1) for i in range(10)]
    return rows


def edge_docs(spark):
    return spark.createDataFrame([(*r, *("z" for _ in CLASHING)) for r in edge_rows()], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
