from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from conftest_llm import ODD, prose

from orrery.llm import near_dup
from orrery.llm.common import WordHashes


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(f"e{rng.randint(0, 10**9)}" if rng.random() < share else w for w in text.split())


def sets_of(texts, size):
    out = []
    for t in texts:
        w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in (t or "").encode().split()]
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute(texts, ids, size, percent=80):
    sets, top = sets_of(texts, size), list(range(len(texts)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                top[root(a)] = root(b)
    group: dict[int, list] = {}
    for k in range(len(texts)):
        group.setdefault(root(k), []).append(ids[k])
    least = {r: min((i for i in g if i is not None), default=None) for r, g in group.items()}
    return [(ids[k], len(sets[k]), least[root(k)], ids[k] == least[root(k)]) for k in range(len(texts))]


def texts():
    base = [prose(100 + k, 40 + 10 * k, 10**6) for k in range(6)]
    near = [edited(b, 10 * k + j, s) for k, b in enumerate(base) for j, s in enumerate((0.01, 0.02, 0.04, 0.08, 0.2))]
    chain = [prose(7, 120, 10**6)]
    for k in range(30):  # neighbours are near, ends are not
        chain.append(edited(chain[-1], 1000 + k, 0.02))
    common = prose(9, 60, 10**6)
    passage = [common + " " + prose(2000 + k, 40, 10**6) for k in range(30)]  # alike, but too little
    return [*ODD, *base, *near, *base, *chain, *passage, *["Copy of one TEXT"] * 30, "copy OF one text", "ONE"]


@pytest.mark.parametrize(("size", "block"), [(2, 2048), (5, 2048), (2, 4)])
def test_against_brute_force(spark, make_docs, size, block):
    all_texts = texts()
    ids = list(range(len(all_texts)))
    random.Random(5).shuffle(ids)
    got = near_dup.linked(make_docs(all_texts, ids), size=size, block=block).collect()
    found = sorted((r["row"]["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)
    assert found == sorted(brute(all_texts, ids, size))


def test_null_and_repeated_ids(spark, make_docs):
    got = near_dup.linked(make_docs(["a b c", "a b c", "a b c", "x y", "x y", None, ""], [None, 5, 5, None, None, None, 3]), size=2).collect()
    found = [(r["row"]["text"], r["row"]["doc_id"], r["component_id"], r["kept"]) for r in got]
    key = lambda x: str(x)
    assert sorted(found, key=key) == sorted([("a b c", None, 5, False), ("a b c", 5, 5, True), ("a b c", 5, 5, True), ("x y", None, None, True), ("x y", None, None, True), (None, None, None, True), ("", 3, 3, True)], key=key)
    kept = near_dup.deduplicated(make_docs(["a b c d e f", "a b c d e f", "q"])).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2] and kept[0].asDict().keys() == {"doc_id", "text", "id", "row", "score"}


def test_empty(spark, make_docs):
    assert near_dup.linked(make_docs([])).count() == 0
    assert [r["kept"] for r in near_dup.linked(make_docs([None, ""])).collect()] == [True, True]


@pytest.mark.parametrize("span", [1 << 23, 1 << 16])
def test_a_bucket_of_many_members(spark, span):
    """Members of a large bucket outside of its component: some are linked with one of it, some with each other, most are alike but not linked."""
    rng, n, values = np.random.default_rng(3), 6000, 228
    sig = rng.integers(0, 1 << 16, (n, values)).astype(np.uint16)
    sets = [rng.choice(10**9, 40, replace=False) for _ in range(n)]
    minor = list(range(n - 300, n))
    for c in minor[:12]:  # each is like a member of the large component
        sig[c], sets[c] = sig[17 * c % 5000], np.concatenate([sets[17 * c % 5000][:38], [c, c + n]])
    for c in minor[12:]:  # alike by their signatures; in their sets only those of one number
        sig[c] = 7
        sig[c, :10] = c
        sets[c] = np.concatenate([np.arange(25), 10**6 + 100 * (c // 8) + np.arange(15)])
    schema = "class long, sig binary, keys array<long>, shingles array<long>"
    classes = spark.createDataFrame([(c, sig[c].tobytes(), [c, 7, c], sets[c].tolist()) for c in range(n)], schema)
    labels = spark.range(n - 300).selectExpr("id AS node", "0L AS component")
    buckets = spark.range(n).selectExpr("id AS class", "7L AS key")
    got = near_dup.partners(buckets, labels, classes, 80, 0.68, 2048, span).collect()
    assert len(got) <= len(minor) * (3 if span > 1 << 20 else 60)  # so many blocks of columns
    top = {c: 0 if c < n - 300 else c for c in range(n)}

    def root(c):
        while top[c] != c:
            c = top[c]
        return c

    for r in got:
        assert 100 * len(set(sets[r["a"]]) & set(sets[r["b"]])) >= 80 * len(set(sets[r["a"]]) | set(sets[r["b"]]))
        x, y = sorted((root(r["a"]), root(r["b"])))
        top[y] = x
    assert all(root(c) == 0 for c in minor[:12])
    assert all((root(c) == root(d)) == (c // 8 == d // 8) for c in minor[12:] for d in minor[12:])


def test_long_texts(spark, make_docs):
    long = prose(3, 60_000, 10**6)
    got = near_dup.linked(make_docs([long, edited(long, 1, 0.01), edited(long, 2, 0.3), prose(4, 60_000, 10**6)])).collect()
    assert {r["row"]["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_sets_that_share_a_class_are_told_apart(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "class long, check long")
    assert [len({r["class"] for r in near_dup.told_apart(df, x).collect()}) for x in ([], [1])] == [2, 3]


def test_components_of_a_path(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    edges = [(a, b) for a, b in zip(order, order[1:], strict=False)] + [(100, 101)]
    got = {r["node"]: r["component"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_similarity():
    sets = [np.unique(s) for s in near_dup.shingle_sets([prose(k, 300, 10**6).encode() for k in (1, 2)], 2, WordHashes())]
    mixed = [sets[0], np.unique(np.concatenate([sets[0][: int(0.9 * len(sets[0]))], sets[1][:20]]))]
    _, sig = near_dup.signatures(mixed, near_dup.BANDS, near_dup.ROWS)
    true = len(np.intersect1d(*mixed)) / len(np.union1d(*mixed))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.1
    assert sig.shape == (2, near_dup.BANDS * near_dup.ROWS)


def test_sets_of_a_long_text_take_little_memory():
    text = " ".join(prose(k, 1000) for k in range(2500)).encode()
    tracemalloc.start()
    try:
        one = near_dup.shingle_sets([text], 5, WordHashes())[0]
        near_dup.class_of(one)
        assert len(text) > 8_000_000 and tracemalloc.get_traced_memory()[1] < 9 * len(text)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize(("span", "part"), [(1, 1), (5, 3), (60, 1000)])
def test_sets_by_spans(monkeypatch, span, part):
    texts = [t and t.encode()[:3000] for t in ODD]
    whole = near_dup.shingle_sets(texts, 3, WordHashes())
    names = [near_dup.class_of(s) for s in whole]
    monkeypatch.setattr(near_dup, "SPAN", span)
    monkeypatch.setattr(near_dup, "PART", part)
    got = near_dup.shingle_sets(texts, 3, WordHashes())
    assert all(map(np.array_equal, got, whole)) and [near_dup.class_of(s) for s in got] == names
    words = [(t or b"").lower().split() for t in texts]
    assert [len(s) for s in got] == [len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}) if w else 0 for w in words]
