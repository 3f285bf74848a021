import pytest

#: Rows that every operator on documents must take: nulls, empty and long texts, ties, repeated rows.
ODD = [
    (1, "a  b\tc", "x"),
    (2, "a b c", "y"),
    (3, None, None),
    (4, "", "x"),
    (5, "   ", "x"),
    (6, "wörld " * 20_000, "x"),
    (7, "solo", None),
    (7, "solo", None),
    (7, "other text of seven", "x"),
    (None, "no id here", "x"),
    (None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, size string").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, size string")
