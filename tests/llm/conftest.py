import pytest

ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "   \n\t ", "en", "s", 5),
    (4, "one", "en", "s", 3),
    (5, "Two WORDS", None, "s", 9),
    (6, "a b c d e f g h i j k l", "en", None, 1),
    (6, "a b c d e f g h i j k l", "en", None, 1),
    (None, "no id at all here", "en", "s", 1),
    (8, "x" * 70_000, "en", "s", 70_000),
    (9, "word " * 30_000 + "END", "fr", "s", 1),
    (10, "Ünïcödé Σίσυφος ΟΔΟΣ İstanbul ﬁn 漢字 <|endoftext|> é don't 3.14   x", "de", "s", 1),
    (11, "1.2.3.4 a@b.co +1 (017) 555-7713 4111111111111111 MIT License", "en", "s", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.select("*", *(F.lit(7).alias(c) for c in ("f", "k", "h", "words", "host", "ids", "prints", "raw", "_row", "shard", "lines", "__h", "__n", "__text")))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
