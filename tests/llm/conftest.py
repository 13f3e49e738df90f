import random

import pytest
from pyspark.sql import functions as F


def prose(seed, n, words=("the", "and", "of", "thing", "ether", "ounce", "when", "shine", "able", "reed", "Über", "né")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.choice(["", "s", "ing", "ed"])) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) rows, with columns whose names clash with what operators add."""

    def build(rows, clash=()):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
        return df.withColumns({c: F.lit("mine") for c in clash})

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, null and repeated ids, ties, repeated rows, and a very long text."""
    long = prose(1, 30_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, "lonely words here"), (None, None), (4, prose(2, 300)), (5, prose(2, 300)), (5, prose(2, 300)),
        (6, long), (7, long + " end"), (8, prose(3, 120)), (8, prose(4, 120)), (9, "a" * 5000), (10, "x"),
    ]
