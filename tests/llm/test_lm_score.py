from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, prose

from orrery.llm import lm_score
from orrery.llm.queries import QUERIES


@pytest.mark.parametrize(("order", "block"), [(1, 1 << 20), (2, 2000), (3, 3000)])
def test_against_brute_force(spark, make_docs, monkeypatch, order, block):
    monkeypatch.setattr(lm_score, "BLOCK", block)
    texts = [*ODD, *(prose(k, 30, 60) for k in range(30)), *["the hot pair"] * 40]
    words = [(t or "").encode().split() for t in texts]
    counts = [Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(counts[0].values())

    def score(w, k):
        penalty = 0.0
        for n in range(min(order, k + 1), 1, -1):
            gram = tuple(w[k - n + 1 : k + 1])
            if counts[n - 1][gram] >= 2:
                return math.log(counts[n - 1][gram] / counts[n - 2][gram[:-1]]) + penalty
            penalty += math.log(0.4)
        return math.log(counts[0][(w[k],)] / total) + penalty

    got = {r["row"]["doc_id"]: r for r in lm_score.scored(make_docs(texts), order=order).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(words):
        want = sum(score(w, k) for k in range(len(w)))
        assert got[i]["n_words"] == len(w) and got[i]["log_score"] == pytest.approx(want)
        assert got[i]["mean_score"] == (pytest.approx(want / len(w)) if w else None)


def test_empty(spark, make_docs):
    assert lm_score.scored(make_docs([])).count() == 0
    assert [r["log_score"] for r in lm_score.scored(make_docs([None, ""])).collect()] == [0, 0]


def test_numbers_survive_squeezing():
    for x in (np.array([], np.uint64), np.array([1, 0, 2**64 - 1, 5], np.uint64), np.arange(3000, dtype=np.int64) ** 4):
        assert lm_score.unsqueezed(lm_score.squeezed(x), x.dtype).tolist() == x.tolist()


def test_query_of_three_words(spark, tmp_path):
    """A third word changes a score only where the query goes beyond pairs."""
    texts = ["a b c"] * 3 + ["x b d"] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_score"] for r in QUERIES["op8_lm_score"](spark, str(tmp_path)).collect()}
    assert got[0] == pytest.approx(math.log(3 / 18) + math.log(3 / 3) + math.log(3 / 3), abs=1e-6)  # by pairs alone, c after b has 3 / 6
    pairs = {r["doc_id"]: r["log_score"] for r in QUERIES["lm_score_order2"](spark, str(tmp_path)).collect()}
    assert pairs[0] == pytest.approx(math.log(3 / 18) + math.log(3 / 3) + math.log(3 / 6), abs=1e-6)


def test_null_ids_and_repeated_rows(spark, make_docs):
    """Rows repeated as a whole count, and are scored, as often as they occur; a null id is an id like others."""
    got = lm_score.scored(make_docs(["a b", "a b", "a b", "c"], [1, 1, None, None])).collect()
    found = sorted(((r["row"]["doc_id"], r["n_words"], round(r["log_score"], 9)) for r in got), key=str)
    pair, one = round(math.log(3 / 7) + math.log(3 / 3), 9), round(math.log(1 / 7), 9)
    assert found == sorted([(1, 2, pair), (1, 2, pair), (None, 2, pair), (None, 1, one)], key=str)


def test_columns_without_a_hash(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'a b a b' AS text, map('k', 1) AS row")
    assert lm_score.scored(docs).first()["n_words"] == 4
