import random

import pytest


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def make(spark):
    """Documents with columns whose names clash with those that operators use inside."""

    def build(rows):
        full = [(i, t, k, "n", k, 1.0, "x") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, n long, node string, key long, score double, x string").repartition(3)

    return build
