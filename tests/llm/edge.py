"""Small document tables with the awkward cases, for all operator tests."""

from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for results or inside
        T.StructField("score", T.DoubleType()),
        T.StructField("key", T.StringType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("n_words", T.StringType()),
    ]
)

BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    BASE,
    BASE,  # an exact copy
    BASE + " tail",  # a near copy
    None,
    "",
    " \t\n ",
    "one",
    "two words",
    "ONE",
    "Ünïcode straße 你好 😀 text with ümlauts and more",
    "x",
    " ".join(f"w{i % 977}" for i in range(60_000)),  # very long
    "a" * 200_000,  # one very long word
    "mail a.b@c.example.com ip 10.0.0.1 call +1 (555) 555-0100 now",
]


def rows(texts=TEXTS):
    """One row per text; ids with a repeat, a null id, a null source."""
    out = []
    for i, t in enumerate(texts):
        doc_id = None if i == 6 else 3 if i == 7 else i * 5
        out.append((doc_id, t, "en", None if i % 4 == 3 else f"s{i % 3}", 0, 0.25, "k", 7, "clash"))
    return out


def frame(spark, texts=TEXTS, partitions=3):
    """The awkward table."""
    return spark.createDataFrame(rows(texts), DOCS).repartition(partitions)


def empty(spark):
    """The table without rows."""
    return spark.createDataFrame([], DOCS)
