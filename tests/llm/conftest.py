import pytest

LONG = "word " * 60_000 + "\n" + "x" * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\n ", "xx", "a", 6), (None, "some text here now", "en", None, 18),
        (4, "One line.\nTwo lines.\nThree lines.\nFour.", "en", "a", 1), (5, "One line.\nTwo lines.\nThree lines.\nFour.", "en", "b", 1),
        (6, "One line.\nTwo lines.\nThree lines.\nFive.", "en", "b", 1), (7, LONG, "en", "c", len(LONG)),
        (8, "same same row", "en", "c", 13), (8, "same same row", "en", "c", 13), (9, "é😀 ß   x", "de", "c", 9), (10, "a", "fr", "d", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "'x' as ids", "1 as n", "'y' as labels", "'z' as rep", "7 as copy_of", "true as tied").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
