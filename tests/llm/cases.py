"""Rows every document operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names operators use inside
CLASH = "bands int, component string, rep string, th string, size string, key int, block int, chunk int, label int, x double, word string, n int"


def prose(seed: int, words: int, vocabulary: int = 40) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))


def rows() -> list[tuple]:
    out = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "word", "en", None, 4), (5, "word", "en", "b", 4),
        (6, "WORD", "en", "b", 4), (7, "é€😀 ünï\x00x", "fr", "a", 9), (8, "x " * 3000, "en", "a", 6000), (9, "y" * 5000, "en", "c", 5000),
        (10, prose(1, 120), "en", "a", 1), (11, prose(1, 120), "en", "b", 1), (12, prose(1, 120) + " more", "en", "a", 1),
        (13, prose(2, 60) + " " + prose(1, 90), "en", "c", 1), (14, "a.b@c.de and +1 (555) 123-4567, 10.0.0.255", "en", "a", 1), (15, "the end", None, "c", 7),
    ]
    return out + [out[10], (16, prose(3, 200), "de", "d", 1)]


def docs(spark, extra: bool = False, data: list[tuple] | None = None):
    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    if extra:
        for c in CLASH.split(", "):
            name, kind = c.split()
            if name not in df.columns:
                df = df.withColumn(name, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast(kind))
    return df


def null_id(spark):
    return docs(spark, data=[*rows(), (None, prose(1, 120), None, None, None), (None, None, None, None, None)])


def empty(spark):
    return docs(spark, data=[])


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)
