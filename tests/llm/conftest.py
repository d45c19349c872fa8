import random

import pytest

from texts import prose


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    long_text = prose(random.Random(5), 30_000)
    rows = [
        (1, "one two three four five six seven", "a", 9, "x"), (1, "one two three four five six seven", "a", 9, "x"),
        (2, None, "a", None, None), (None, None, None, None, None), (None, "one two three four five six seven", None, 1, "y"),
        (3, "", "b", 0, "z"), (4, " \n\t ", "b", 0, "z"), (5, long_text, None, 3, "w"), (6, long_text, "a", 3, "w"), (7, "ñandú Ünïcode 漢字 \x0b end", "c", 1, "v"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept int, _row string").selectExpr("*", "kept AS shard", "kept AS score", "kept AS node")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
