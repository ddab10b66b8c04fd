"""Small tables with the cases every operator has to bear, and plain versions to compare with."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 53}" for i in range(30_000))


def rows(*texts, first: int = 0):
    return [(first + i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]


def prose(seed: int, n: int = 80) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["an", "er", "th", "on", "re", "in"]) for _ in range(draw.randint(1, 3))) for _ in range(n))


HARD = rows(None, "", " \n\t ", "a", "same text here", "same text here", LONG, "Café naïve 日本 🙂", prose(1), prose(1))


def documents(spark, data=HARD, partitions: int = 3):
    return spark.createDataFrame(data, DOCUMENTS).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def with_odd_columns(df):
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("keep_id", "_hash", "_text", "kept", "n", "node", "class", "bucket", "component", "label", "score", "length", "_rank", "path"):
        df = df.withColumn(name, F.lit("x"))
    return df


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
