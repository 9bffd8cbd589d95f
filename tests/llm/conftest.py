import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [
        (1, "The quick brown fox. It jumps over the lazy dog near the river bank today.", "en", "a", 1),
        (1, "The quick brown fox. It jumps over the lazy dog near the river bank today.", "en", "a", 1),
        (2, None, None, None, None), (3, "", "fr", "b", 0), (None, "no id here, but some words to look at, all the same, here and there", None, "a", 3), (4, long, "de", "b", len(long)),
        (5, "The quick brown fox. It jumps over the lazy dog near the river bank today.", "en", None, 1), (6, " \t\n", None, "c", 3), (7, "日本語 é😀 <|endoftext|>", "xx", "c", 9), (8, long, "de", "b", 1),
    ]
    extra = ["kept", "ids", "score", "copies", "n_words", "_words", "label", "fingerprint"]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"'{x}' AS {x}" for x in extra])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
