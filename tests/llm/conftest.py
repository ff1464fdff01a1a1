import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, FP string, `key` string, `a b` int, mix_epoch int"
LABEL = "doc_id long, quality int, toxic int, `text` string"


def prose(seed: int, n: int) -> str:
    return " ".join(f"word{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = prose(5, 30_000)
    rows = [
        (1, prose(1, 40)), (2, prose(1, 40)), (3, None), (4, ""), (5, "   \n\t "), (6, long), (7, long + " end"),
        (None, prose(1, 40)), (None, None), (8, "one"), (9, "One Two"), (9, "One Two"), (9, "another text of that id"),
        (10, "Ünïcode İ ſ <|endoftext|> a\x1cb 日本 don't 12.5"), (50, "idiot " * 3), (100, prose(9, 300)),
    ]
    return [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 2}", None, "x", None, n, n) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENT)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0, None), (1, 0, 0, "x"), (4, 0, None, None), (50, 1, 1, None), (None, 1, 1, None), (100, None, 0, None)]
    return spark.createDataFrame(rows, LABEL)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABEL)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").withColumn("extra", F.lit(1))
