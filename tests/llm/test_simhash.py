from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from conftest_llm import ODD, prose

from orrery.llm import simhash


def fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, ids):
    """Component ids by comparing all pairs."""
    top = list(range(len(prints)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    values = np.array(prints, np.uint64)
    for a in range(len(prints)):
        for b in np.nonzero(np.bitwise_count(values[:a] ^ values[a]) <= 2)[0]:
            top[root(a)] = root(int(b))
    least: dict[int, int | None] = {}
    for k in range(len(prints)):
        r = root(k)
        known = [x for x in (least.get(r), ids[k]) if x is not None]
        least[r] = min(known) if known else None
    return [least[root(k)] for k in range(len(prints))]


def texts():
    base = [prose(k, 200, 10**6) for k in range(20)]
    rng, near = random.Random(3), []
    for b in base:
        for share in (0.005, 0.005, 0.02, 0.1):
            near.append(" ".join(f"e{rng.randint(0, 99)}" if rng.random() < share else w for w in b.split()))
    return [*ODD, *base, *near, *base[:5], "ONE", "One two", *["many copies of one text"] * 40, prose(8, 90_000)]


def test_against_brute_force(spark, make_docs):
    all_texts = texts()
    ids = list(range(len(all_texts)))
    random.Random(1).shuffle(ids)
    got = {r["row"]["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.linked(make_docs(all_texts, ids)).collect()}
    prints = [fingerprint(t) for t in all_texts]
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, brute(prints, ids), strict=True)}
    assert len({c for _, c in got.values()}) < len(set(prints))  # some are linked that aren't equal
    assert got[ids[0]][0] == "0" * 16


def flipped(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("limit", [1024, 16, 3])
def test_links_of_prints(spark, limit):
    """Clusters around some fingerprints, with buckets that hold more than the limit; each component is found whole."""
    rng = random.Random(limit)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for center in [rng.getrandbits(64) for _ in range(12)]:
        prints |= {flipped(rng, center, rng.randint(0, 4)) for _ in range(60)}
    high = rng.getrandbits(48) << 16
    prints |= {high | rng.getrandbits(16) for _ in range(150)}  # 48 bits are equal
    prints |= {flipped(rng, p, rng.randint(1, 3)) for p in list(prints)[:200]}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    links = [(r["a"], r["b"]) for r in simhash.linked_prints(df, limit=limit).collect()]
    assert all((a ^ b).bit_count() if (a < 0) == (b < 0) else True for a, b in links)
    ids = list(range(len(prints)))
    where = {p: k for k, p in enumerate(signed)}
    top = ids[:]

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in links:
        x, y = sorted((root(where[a]), root(where[b])))
        top[y] = x
    assert [root(k) for k in ids] == brute(prints, ids)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_close_pairs(monkeypatch, radius):
    monkeypatch.setattr(simhash, "WORDS", 40)
    rng = random.Random(radius)
    units, prints = [], []
    for u, n in enumerate([1, 2, 3, 70, 1, 200, 5, 64, 65, 1]):
        center = rng.getrandbits(64)
        units += [u] * n
        prints += [flipped(rng, center, rng.randint(0, 5)) for _ in range(n)]
    found = [(int(a), int(b)) for one, two in simhash.close_pairs(np.array(prints, np.uint64), np.array(units), radius) for a, b in zip(one, two, strict=True)]
    want = [(a, b) for b in range(len(prints)) for a in range(b) if units[a] == units[b] and (prints[a] ^ prints[b]).bit_count() <= radius]
    assert sorted(found) == sorted(want)


def test_null_and_repeated_ids(spark, make_docs):
    got = simhash.linked(make_docs(["a b c", "A B c", "x y", None, " ", "x y"], [None, 4, None, None, 9, None])).collect()
    assert sorted(((r["row"]["text"], r["component_id"]) for r in got), key=repr) == sorted([("a b c", 4), ("A B c", 4), ("x y", None), (None, 9), (" ", 9), ("x y", None)], key=repr)
    assert got[0]["row"].asDict().keys() == {"doc_id", "text", "id", "row", "score"}


def test_empty(spark, make_docs):
    assert simhash.linked(make_docs([])).count() == 0
    assert [r["component_id"] for r in simhash.linked(make_docs([None])).collect()] == [0]
