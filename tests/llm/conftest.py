from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 33),
        (1, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", None, "b", None),
        (3, None, "en", None, None),
        (None, "one two three four five six seven", "de", None, 1),
        (None, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "fr", "a", 4),
        (6, long, "en", "b", len(long)),
        (7, long + " end", "en", None, 1),
        (8, "!!! 123 ???", "en", "a", 9),
        (9, "été ÜBER señor", "fr", "c", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 AS score", "'x' AS node", "2 AS size", "3 AS k", "'y' AS label", "4 AS row", "5 AS pos", "6 AS cuts", "7 AS body")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
