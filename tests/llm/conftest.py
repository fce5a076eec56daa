import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows and columns with names that operators use."""
    prose = "The quick brown fox jumps over the lazy dog and then it runs home again. " * 12
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (1, prose, "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (4, prose, "en", "b", 5),
        (None, prose, "en", "a", 1), (None, None, None, None, None), (5, long, "en", "b", 1), (6, "Hi.", "en", "a", 3),
        (6, "Hi.", "en", "a", 3), (7, " \t\n ", "de", "c", 1), (8, "ÄÖÜ ß 日本語 \U0001f600", "de", None, 1),
    ]
    extra = "size long, row string, shard int, key long, target double, _of string, `a.b` string, kept boolean"
    return spark.createDataFrame([r + (1, "x", 2, 3, 4.0, "y", "z", True) for r in rows], f"{COLUMNS}, {extra}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def rng():
    return random.Random(7)
