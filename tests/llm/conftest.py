import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spark_part int"

LONG = " ".join(f"word{i % 977}" for i in range(60_000))

#: Nulls in every column, empty and very long texts, ties, repeated rows.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank", "en", "a", 66, 0),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank", "en", "a", 66, 0),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank", "en", "a", 66, 0),
    (3, "", "en", "b", 0, 1),
    (4, None, None, None, None, None),
    (5, "   \t\n ", "de", "b", 6, 1),
    (6, LONG, "en", "a", len(LONG), 2),
    (None, "no id at all but some words here", "en", None, 32, 2),
    (7, "ünïcödé straße œuvre Ω 漢字 İstanbul", "de", "c", 33, 3),
    (8, "one", None, "c", 3, 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    """A small table with every odd case; the column spark_part clashes with nothing that operators may add."""
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
