import pytest

#: Rows that every operator must bear: nulls, empty and very long texts, repeated rows, ties, odd characters.
LONG = " ".join(f"wort{i % 997} lorem{i} ipsum." for i in range(9000))
ODD = [
    (1, None), (2, ""), (3, "   \n\t\n"), (4, "ein Wort"), (5, "x" * 5000), (6, LONG), (6, LONG), (7, "a\x00b\x1cc\x85d e　f <|endoftext|> \U0001f600 ́"),
    (None, "no id but words enough to be a text of its own in this table of texts"), (8, "tie tie tie tie tie tie"), (9, "tie tie tie tie tie tie"), (2, "same id, other text"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above, with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("text_hash", "node", "first", "last", "id", "n", "_bw_hash", "_bw0", "lines", "key", "root", "part", "place")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
