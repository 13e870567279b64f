import pytest
from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, words string, t string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, very long texts, ties, repeated rows and clashing extra columns."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, 1, "a", "b"), (2, "", "en", "s", 0, 1, "a", "b"),
        (3, " \t\n ", "en", "s", 4, 1, "a", "b"), (4, "one", "en", "s", 3, 1, "a", "b"),
        (5, long_text, "en", "z", 1, 1, "a", "b"), (6, "tie " * 60, "en", "s", 1, 1, "a", "b"),
        (7, "tie " * 60, "en", "s", 1, 1, "a", "b"), (7, "tie " * 60, "en", "s", 1, 1, "a", "b"),
        (8, "ünï çode \U0001f600 𝔘 password=abcdef123 fin\n\n" * 3, "fr", None, 1, 1, "a", "b"),
        (None, "row without an id " * 20, "en", "q", 1, 1, "a", "b"),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where(F.lit(False))


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="session")
def pages(spark, small):
    return spark.read.parquet(f"{small}/pages.parquet").cache()
