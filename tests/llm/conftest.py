import pytest

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "é" * 500


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, "A short text with a few words, and then a few words more.", "en", "s", 3, "x"),
        (1, "A short text with a few words, and then a few words more.", "en", "s", 3, "x"),
        (2, None, "en", None, None, None),
        (3, "", None, "s", 0, "y"),
        (4, " \n\t ", "en", "s", 4, "z"),
        (5, LONG, "en", "s", len(LONG), "z"),
        (None, "A text without an id.", "en", "s", 21, "z"),
        (6, "two words", "en", "s", 9, "z"),
        (7, "two words", "en", "s", 9, "z"),
        (8, "mail a.b@c.example.org or +1 (201) 555-0100, card 4111 1111 1111 1111 <|endoftext|>", "en", "s", 1, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").withColumns(
        {c: __import__("pyspark.sql.functions", fromlist=["lit"]).lit("taken") for c in ("kept", "content", "dropped", "pii_spans", "licenses", "token_ids")}
    )


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("doc_id < -1")
