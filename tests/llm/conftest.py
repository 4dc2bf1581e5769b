import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that operators use."""
    fields = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, pattern string, key string, part string"
    rows = [
        (1, "a b c d e f g h", "en", "s1", 15, 7, 1, "p", "k", "q"),
        (1, "a b c d e f g h", "en", "s1", 15, 7, 1, "p", "k", "q"),
        (2, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "s2", 0, 7, 1, "p", "k", "q"),
        (4, " \t\n", "en", "s2", 3, 7, 1, "p", "k", "q"),
        (None, "a b c d e f g h", "en", None, 15, 7, 1, "p", "k", "q"),
        (None, None, None, "s1", None, None, None, None, None, None),
        (5, "one two", "en", "s3", 7, 7, 1, "p", "k", "q"),
        (6, "long " * 30_000, "en", "s1", 150_000, 7, 1, "p", "k", "q"),
        (7, "x" * 50_000 + " é日本 mail me@example.com", "fr", "s2", 50_000, 7, 1, "p", "k", "q"),
        (8, "A B C D E F G H", "en", "s1", 15, 7, 1, "p", "k", "q"),
    ]
    return spark.createDataFrame(rows, fields)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
