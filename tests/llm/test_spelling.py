from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD

from orrery.llm import spelling

RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(texts, ids):
    counts: Counter[str] = Counter()
    for doc, text in zip(ids, texts, strict=True):
        for run in RUNS.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    letters = {c for w in n for c in w}

    def near(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + j :] for j in (0, 1) for i in range(len(w) + 1 - j) for c in letters}
        return (out - {w}) & n.keys()

    form = {}
    for w in n:
        best = min(near(w), key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near(w)), n[form[w]] if form[w] else None) for w in n), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def texts():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdéß×É") for _ in range(rng.randint(7, 12))) for _ in range(60)]
    out = []
    for k in range(120):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = base[int(rng.paretovariate(0.7)) % 60]
            if rng.random() < 0.15:
                i = rng.randrange(len(w))
                w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdz") + w[i:], w[:i] + rng.choice("abcdz") + w[i + 1 :]))
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append(rng.choice(" ,.-1\n").join(words))
    # a chain of forms, ties of equal counts, double letters, and a very long word
    chain = [("abcdefg", 1300), ("abcdefgh", 120), ("abcdefghi", 11), ("abcdefghij", 1), ("tiewordé", 40), ("tiewordè", 40), ("tieword", 4), ("aaaaaaaa", 30), ("aaaaaaa", 3), ("aaaaaaaaa", 300)]
    out += [" ".join([w] * n) for w, n in chain] + ["abcdefghij", ("y" * 9_000 + " ") * 3, ("y" * 9_001 + " ") * 40]
    return [*ODD, *out]


def test_against_brute_force(spark):
    all_texts = texts()
    ids = list(range(len(all_texts)))
    ids[5] = None
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, all_texts, strict=True)], "doc_id long, text string, word string")
    got = rows(spelling.variants(docs))
    assert got == brute(all_texts, ids)
    roots = {r[0]: r[2] for r in got}
    assert len(got) > 100 and roots["abcdefghi"] == "abcdefg" and sum(r[1] is not None for r in got) > 10


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_neighbours_are_all_and_distinct(monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(2)
    alphabet = "abé"
    letters, weights = spelling.points_of(alphabet), spelling.Weights()
    for size in (1, 2, 7, 11):
        words = ["".join(rng.choice(alphabet) for _ in range(size)) for _ in range(9)]
        for full in (np.full(4, 2**64 - 1, np.uint64), np.zeros(4, np.uint64)):
            found = list(spelling.neighbours(words, alphabet, letters, weights, full))
            if not full[0]:
                assert not found
                continue
            want = []
            for w in words:
                near = {w[:i] + w[i + 1 :] for i in range(size)} | {w[:i] + c + w[i + j :] for j in (0, 1) for i in range(size + 1 - j) for c in alphabet}
                want += [(w, v) for v in near - {w}]
            assert sorted(found) == sorted(want)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    words = spark.createDataFrame([("abcdefg", 5), ("abcdefgh", 50), ("abcdefx", 7), ("zzzzzzzz", 9)], "word string, n long")
    monkeypatch.setattr(spelling, "MOST_BITS", 64)
    got = {(r["word"], r["near"], r["near_n"]) for r in spelling.near_words(words).collect()}
    assert got == {("abcdefg", "abcdefgh", 50), ("abcdefgh", "abcdefg", 5), ("abcdefg", "abcdefx", 7), ("abcdefx", "abcdefg", 5)}


def test_empty(spark, make_docs):
    assert spelling.variants(make_docs([])).count() == 0
    assert spelling.variants(make_docs([None, "", "once seen"])).count() == 0
