"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("shard", "slot", "bucket", "mix", "words", "block", "epoch", "first_word", "fingerprint", "component_id", "digest", "row", "fp", "toxicity", "size", "maybe", "root", "id", "probability", "value")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words))


def odd_rows() -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars) with all odd cases; ids of equal rows repeat."""
    long = prose(1, 60_000)
    texts = [None, "", "   \t\n ", "one", "Two words", prose(2, 40), prose(2, 40).upper(), prose(3, 50), prose(3, 50) + " tail", "É à ß 漢字 \U0001f600 " * 30, long, long, "a " * 500, "the the the the"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    same = (7, prose(4, 30), "en", "s1", 99)
    return rows + [same, same, (None, prose(5, 20), "fr", "s2", None), (None, None, None, None, None), (None, prose(5, 20), "fr", "s2", None)]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df: DataFrame) -> DataFrame:
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHES])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
