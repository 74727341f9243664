import pytest

#: Rows that every operator must take: nulls, empty and blank texts, ties, repeated rows, odd characters.
ODD = [
    (1, "Hello  world", "en"),
    (2, " Hello world ", "en"),
    (3, "Helloworld", "en"),
    (4, None, "en"),
    (5, "", None),
    (6, " \t\n", "de"),
    (7, "Ünïcödé ▁▁ mark ▁ <s> </s> \x00 \U0001f600 \x1c it's 12345 don't  ", "fr"),
    (8, "a", "es"),
    (8, "a", "es"),
    (None, "null id", None),
    (9, "x" * 5000, "en"),
    (10, "trailing   ", "en"),
    (11, "  leading\n\n line  two\t\ttabs", "en"),
    (12, "word " * 3000, "en"),
    (13, "́combining space wide İI", "fr"),
    (14, "12 34 !!", "en"),
    (15, "\x02a \x03b \x01c  <|endoftext|> d<|startoftext|>e <| x", "en"),
]
SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.withColumns({c: F.lit("extra") for c in ("row", "kept", "size", "ids", "file", "start", "score", "n", "best", "digest", "label", "k")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
