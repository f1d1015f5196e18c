from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from orrery.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, row string"


def brute(rows, parts=16, entries=64, rounds=2):
    """Codes and errors by comparing every part with every entry, in Python's integers."""
    fine = [(i, [math.floor(Fraction(x) * 256) for x in v], v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not fine:
        return [], []
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(fine[0][1])
    fine = [r for r in fine if len(r[1]) == size]
    bounds = [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]
    books = [[list(v[a:b]) for _, v, _ in fine[:entries]] for a, b in bounds]

    def nearest(book, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    def assign():
        return [[nearest(books[p], v[a:b]) for p, (a, b) in enumerate(bounds)] for _, v, _ in fine]

    for _ in range(rounds):
        found = assign()
        for p, (a, b) in enumerate(bounds):
            for e in range(len(books[p])):
                mine = [v[a:b] for (_, v, _), f in zip(fine, found, strict=True) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, bytes(k for _, k in f).hex(), min(2**63 - 1, sum(d for d, _ in f))) for (i, _, _), f in zip(fine, assign(), strict=True)], books


def run(spark, rows, labels=None, **how):
    df = spark.createDataFrame([(i, v, (labels or {}).get(i), "c", "r") for i, v in rows], SCHEMA)
    out, books = vector_codes.encoded(df, **how)
    return sorted(((r["row"]["vec_id"], r["code"].hex(), r["error"]) for r in out.collect()), key=repr), books


def made(seed, n, d, scale):
    rng = np.random.default_rng(seed)
    return [(k, v.tolist()) for k, v in enumerate(rng.normal(0, scale, (n, d)).astype(np.float32).astype(float))]


@pytest.mark.parametrize(("n", "d", "how"), [(400, 32, {}), (40, 16, {}), (150, 8, {"parts": 3, "entries": 5, "rounds": 4}), (90, 20, {"parts": 16, "entries": 7}), (30, 0, {})])
def test_against_brute_force(spark, n, d, how):
    rows = made(n + d, n, d, 0.25)
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (1000, None), (1001, [None] * d), (1002, [0.1] * (d + 1)), *[(2000 + k, rows[k][1]) for k in range(20)]]
    rows += [(1003, [float("nan")] * d), (1004, [float("inf")] * d)] if d else []
    got, books = run(spark, rows, **how)
    want, want_books = brute(rows, **how)
    assert got == sorted(want, key=repr)
    assert [[list(e) for e in b] for b in books] == want_books


def test_ties_go_to_the_lower_index(spark):
    rows = [(k, [float((k * 7) % 5)] * 4) for k in range(30)]  # entries that are equal, and parts between two
    got, _ = run(spark, rows, parts=2, entries=8)
    assert got == sorted(brute(rows, parts=2, entries=8)[0], key=repr)


@pytest.mark.parametrize("where", ["first", "late", "all"])
def test_large_components(spark, where):
    """Beyond what 64 bits hold: in entries, in other vectors, in all of them."""
    rows = made(5, 120, 8, 0.5)
    for k in {"first": (0, 3, 90), "late": (70, 71, 100), "all": range(120)}[where]:
        rows[k] = (k, [x * (1e30 if k % 2 else 1e9) for x in rows[k][1]])
    got, books = run(spark, rows, parts=4, entries=16)
    want, want_books = brute(rows, parts=4, entries=16)
    assert got == sorted(want, key=repr)
    assert [[list(e) for e in b] for b in books] == want_books


@pytest.mark.parametrize("labels", [1, 1 << 16])
def test_label_errors(spark, labels):
    rows = [(k, e, lab) for k, (e, lab) in enumerate([(5, 1), (6, 1), (2**63 - 1, 2), (2**63 - 1, 2), (3, None), (4, None)])]
    df = spark.createDataFrame(rows, "vec_id long, error long, label int")
    got = {r["vec_id"]: r["label_error"] for r in vector_codes.with_label_error(df, "label", labels).collect()}
    assert got == {0: 11, 1: 11, 2: 2**63 - 1, 3: 2**63 - 1, 4: 7, 5: 7}


def test_radius_leaves_most_entries_out():
    """The scan looks at entries inside the radius only, and finds what a full comparison does."""
    rng = np.random.default_rng(1)
    entries = [tuple(map(int, e)) for e in rng.integers(-1000, 1000, (64, 4))]
    book = vector_codes.Book(entries, vector_codes.bound_of(4))
    x = np.array(entries)[rng.integers(0, 64, 500)] + rng.integers(-20, 20, (500, 4))
    squares = ((x[:, None, :] - np.array(entries)[None]) ** 2).sum(axis=2)
    start = squares.argmin(axis=1)
    index, far = book.assign(x, start)
    assert (index == squares.argmin(axis=1)).all() and (far == squares.min(axis=1)).all()
    inside = [np.searchsorted(book.spans[a], 4 * f, side="right") for a, f in zip(start, far, strict=True)]
    assert np.mean(inside) < 2
    index, far = book.assign(x, rng.integers(0, 64, 500))  # from anywhere
    assert (index == squares.argmin(axis=1)).all()


def test_digest_and_empty(spark):
    assert vector_codes.digest([[(1, -2), (3, 4)], [(5,), (6,)]]) == hashlib.sha256(b"1,-2,3,4,5,6").hexdigest()
    for rows in ([], [(1, None)]):
        got, books = run(spark, rows)
        assert got == [] and books == [[] for _ in range(16)]
    with pytest.raises(ValueError, match="256"):
        vector_codes.encoded(spark.createDataFrame([], SCHEMA), entries=257)
