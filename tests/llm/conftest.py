import pytest

LONG = "the long text goes on and on, word after word. " * 3000
EDGE = [
    (1, None, "en", "s1", 0),
    (2, "", None, None, None),
    (3, "one two", "en", "s1", 7),
    (4, LONG, "fr", "s2", None),
    (5, "a b c d e f g h " * 9, "en", "s1", 1),
    (5, "a b c d e f g h " * 9, "en", "s1", 1),
    (6, "a b c d e f g h " * 9, None, "s1", 1),
    (None, "no id " * 20, "en", None, 1),
    (7, " \n\n \t ", "en", "s3", 1),
    (8, "éé 漢字 😀\nline " * 12, "de", "s3", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = ["k", "t", "n", "s", "x", "fp", "doc", "ids", "decoded", "spans", "base", "size", "target", "copies", "kept", "media", "g", "d", "c", "lo", "hi", "tokens", "sketch"]
    return df.select("*", *[F.lit(9).alias(c) for c in clash])


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
