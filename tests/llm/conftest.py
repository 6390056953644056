import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, "one two three four", "en", "b", 1),
        (3, "word " * 40_000, "en", "a", 2),
        (4, "é　ß  x\n\n y\t", "fr", None, 3),
        (4, "é　ß  x\n\n y\t", "fr", None, 3),
        (5, "the same text over and over\n" * 30, "en", "a", 4),
        (6, "the same text over and over\n" * 30, "en", "c", 4),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS bits", "'x' AS _t", "2 AS shard", "3 AS size", "4 AS kept", "5 AS target", "6 AS length")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
