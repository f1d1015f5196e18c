from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, id string, row string, score double"


@pytest.fixture
def make_docs(spark: SparkSession):
    """Documents of texts, with columns whose names the operators use themselves."""

    def make(texts: list[str | None], ids: list[int | None] | None = None):
        return spark.createDataFrame([(ids[k] if ids else k, t, "x", "y", 0.5) for k, t in enumerate(texts)], SCHEMA)

    return make


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


#: Null, empty, blank, other white space, one word, very long, long without a space, signs, repeated.
ODD = [None, "", "  \n\t ", "\u00a0a\u3000b\x1cc", "one", prose(1, 30_000), "z" * 20_000, "|#*$%&<> !! ..,, \U0001f600 é É", "a a a a a a a a a a a a a a a a a a", "a b c d", "a b c d"]
