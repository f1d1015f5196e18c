from __future__ import annotations

import random

import pytest
from conftest_llm import ODD, prose

from orrery.llm import substring


def brute(texts, ids, n=13):
    first = {}
    words = [(t or "").encode().split() for t in texts]
    for i, w in zip(ids, words, strict=True):
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1) if i is not None else ():
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def texts():
    rng = random.Random(4)
    passages = [prose(k, n, 10**6) for k, n in enumerate((12, 13, 14, 30, 60, 200))]
    out = [*ODD, "a " * 40, "a " * 25, "a b " * 30]
    for k in range(60):
        body = prose(500 + k, rng.randint(0, 80), 10**6).split()
        at = rng.randint(0, len(body))
        out.append(" ".join([*body[:at], rng.choice(passages), *body[at:], rng.choice(passages)]))
    return [*out, *[passages[4]] * 20, out[-1], out[-1]]


@pytest.mark.parametrize(("capacity", "block"), [(1 << 20, 1 << 20), (5, 300), (60, 2000)])
def test_against_brute_force(spark, make_docs, monkeypatch, capacity, block):
    monkeypatch.setattr(substring, "BLOCK", block)
    all_texts = texts()
    ids: list = list(range(len(all_texts)))
    random.Random(1).shuffle(ids)
    ids[20], ids[30], ids[31] = None, 70, 70
    got = substring.deduplicated(make_docs(all_texts, ids), capacity=capacity).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=key) == sorted(brute(all_texts, ids), key=key)
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)


def test_verbatim_and_empty(spark, make_docs):
    a = prose(1, 40, 10**6)
    got = substring.deduplicated(make_docs([f"x\n\n{a}", f"  y\n{a} z ", "p\n q "]), verbatim=True).collect()
    assert {r["row"]["doc_id"]: r["kept_text"] for r in got} == {0: f"x\n\n{a}", 1: "y z", 2: "p\n q "}
    assert substring.deduplicated(make_docs([])).count() == 0
    assert substring.deduplicated(make_docs([None, ""])).count() == 2
