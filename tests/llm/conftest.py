import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `print` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, and a column whose name an operator uses inside."""
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "one two"), (5, "a" * 50), (6, "the quick brown fox jumps over the lazy dog " * 4000), (7, "é — “x” 漢字 ퟿ <|endoftext|> don't\x1cstop"), (7, "é — “x” 漢字 ퟿ <|endoftext|> don't\x1cstop"), (None, "no id here at all"), (9, "123 456 !!")]
    return spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
