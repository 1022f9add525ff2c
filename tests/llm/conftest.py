import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty texts, ties, repeated rows and extra columns."""
    long = " ".join(f"word{i}" for i in range(30_000))
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en", "a", 1, "x"), (2, base, "en", "b", 1, "x"), (3, base.replace("w59", "z"), "en", None, 1, None),
            (3, base.replace("w59", "z"), "en", None, 1, None), (4, None, None, "a", None, "x"), (5, "", "de", "b", 0, "x"), (6, " \n\t", "de", "c", 3, "x"),
            (None, "one two three", None, None, 13, "x"), (7, "One two THREE", "fr", "c", 13, "x"), (8, long, "en", "a", len(long), "x"),
            (9, "secret = 'abcdef123' 😀 password: abc token:api_key=zzzzzz", "en", "b", 5, "x"), (10, "x▁y café 日本語", "es", "d", 9, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 1, 0), (9, 0, 1), (10, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
