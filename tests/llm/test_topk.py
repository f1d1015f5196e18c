from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    fine = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in fine if i % 20 == 0}):
        near = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in fine if j != i))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("n", "d", "step"), [(300, 16, 1024), (300, 16, 40), (30, 3, 1024)])
def test_against_brute_force(spark, monkeypatch, n, d, step):
    monkeypatch.setattr(topk, "SHARD", 97)
    monkeypatch.setattr(topk, "BLOCK", 5)
    rng = np.random.default_rng(n + step)
    x = rng.normal(0, 0.25, (n, d)).astype(np.float32)
    x[5:25] = x[5]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(7, x[7].tolist()), (20, x[20].tolist()), (None, x[1].tolist()), (400, None), (500, []), (600, [float("nan")] * d), (601, [None] * d), (602, [1e30] * d)]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], SCHEMA)
    got = topk.searched(df, F.col("vec_id") % 20 == 0, 20).collect()
    want = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(rows, 20)]
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == want
    assert {i for _, _, i, _ in want} >= {602} and {q for q, *_ in want} >= {500}  # of huge components; an empty vector


def test_large_components(spark, monkeypatch):
    """Beyond 2^24, where sums of floats are not exact, and beyond scores of 64 bits, which are cut to them but ranked whole."""
    monkeypatch.setattr(topk, "SHARD", 50)
    rng = np.random.default_rng(8)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(0, 0.25, (90, 16)).astype(np.float32))]
    rows += [(100 + k, v.tolist()) for k, v in enumerate(rng.normal(0, 1e6, (61, 16)).astype(np.float32))]
    rows += [(200 + k, v.tolist()) for k, v in enumerate(rng.normal(0, 1e16, (21, 16)).astype(np.float32))]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], SCHEMA)
    got = topk.searched(df, F.col("vec_id") % 20 == 0, 25).collect()
    want = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(rows, 25)]
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == want
    assert any(s == 2**63 - 1 for *_, s in want) and any(10**15 < s < 2**63 - 1 for *_, s in want)


def test_one_shard_in_steps(monkeypatch):
    monkeypatch.setattr(topk, "STEP", 64)
    rng = np.random.default_rng(3)
    x, q = rng.integers(-20, 20, (1000, 32)).astype(float), rng.integers(-20, 20, (7, 32)).astype(float)
    ids = np.sort(rng.choice(5000, 1000, replace=False))
    a, c, s = topk.best_of_shard(ids, x, np.full(7, -1), q, 10)
    scores = x @ q.T
    want = [(j, int(i), scores[i, j]) for j in range(7) for i in np.lexsort((ids, -scores[:, j]))[:10]]
    assert list(zip(a.tolist(), c.tolist(), s.tolist(), strict=True)) == want


def test_empty(spark):
    assert topk.searched(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert topk.searched(spark.createDataFrame([(20, [0.5], "s")], SCHEMA), F.col("vec_id") % 20 == 0, 20).count() == 0
