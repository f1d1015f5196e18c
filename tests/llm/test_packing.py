from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import ODD, prose
from tokenizers import Tokenizer

from orrery.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def fewest(sizes: list[int], capacity: int) -> int:
    """The least number of bins, by trying all."""
    best = [len(sizes)]

    def go(k: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i, b in enumerate(bins):
            if b + sizes[k] <= capacity and b not in bins[:i]:
                go(k + 1, [*bins[:i], b + sizes[k], *bins[i + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_the_best_on_small_cases(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 10))), reverse=True)
    plan = packing.plan(dict(Counter(sizes)), 100)
    used = Counter()
    for filling, m in plan:
        assert sum(filling) <= 100
        for s in filling:
            used[s] += m
    assert used == Counter(sizes) and sum(m for _, m in plan) == fewest(sizes, 100)


def test_plan_of_many_meets_the_bound():
    rng = random.Random(1)
    sizes = Counter(min(4096, max(1, int(rng.lognormvariate(6.5, 1)))) for _ in range(20_000))
    bins = sum(m for _, m in packing.plan(dict(sizes)))
    assert bins == sizes[4096] + -(-sum(s * n for s, n in sizes.items() if s < 4096) // 4096)
    assert packing.plan({}) == [] and packing.plan({4096: 3}) == [((4096,), 3)]


@pytest.mark.parametrize(("sizes", "least"), [({1: 1001}, 1), ({1: 10_000}, 3), ({1: 5000, 700: 300}, 60), ({2: 3000, 3: 3000, 4: 3000}, 7)])  # at most five pieces of 700 fit
def test_plan_of_many_short_pieces(sizes, least):
    used = Counter()
    plan = packing.plan(sizes)
    for filling, m in plan:
        assert sum(filling) <= 4096
        used.update({s: m * n for s, n in Counter(filling).items()})
    assert used == Counter(sizes) and sum(m for _, m in plan) == least


def test_branchings_count_from_the_first_incumbent_on():
    rng = random.Random(107)
    sizes = dict(Counter(rng.randint(100, 400) for _ in range(60)))
    bins = [sum(m for _, m in packing.plan(sizes, 1000, nodes=n)) for n in (0, 12)]
    assert bins == [16, -(-sum(s * n for s, n in sizes.items()) // 1000)]  # the first descent alone takes more than 12


def test_fillings_are_undominated():
    counts = {50: 1, 30: 2, 20: 1, 5: 1}
    found = packing.fillings(counts, 60)
    assert found[0][0] == min(60 - sum(c) for n in range(5) for c in combinations([50, 30, 30, 20, 5], n) if sum(c) <= 60)
    assert all(60 - sum(f) == w for w, f in found)


def check(rows, texts, capacity):
    known = Tokenizer.from_file(PATH)
    ids = [[*known.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    seqs, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        k = r["row"]["doc_id"]
        part = np.array(ids[k][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[k].append((r["piece"], r["start"], r["length"]))
    for k, x in enumerate(ids):
        assert sorted(seen[k]) == [(p, p * capacity, min(capacity, len(x) - p * capacity)) for p in range(-(-len(x) // capacity))]
    for places in seqs.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(seqs)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_places(spark, make_docs, capacity):
    texts = [*ODD, *(prose(k, 5 + 7 * (k % 9)) for k in range(80)), *["same text"] * 40, "x <|ENDOFTEXT|> y<|endoftext|>z. a", "É. ΣΑΣ, İ. e\u0301. don't, 12. \x01 q\x01 r"]
    rows = packing.packed(packing.pieces(make_docs(texts), PATH, capacity=capacity), capacity).collect()
    n = check(rows, texts, capacity)
    bound = -(-sum(r["length"] for r in rows) // capacity)
    assert bound <= n <= bound + 1
    with_ids = packing.pieces(make_docs(texts[:3]), PATH, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)


def test_no_rows(spark, make_docs):
    assert packing.packed(packing.pieces(make_docs([]), PATH)).count() == 0


def test_repeated_rows_and_null_ids(spark, make_docs):
    rows = packing.packed(packing.pieces(make_docs(["a b", "a b", "a b"], [None, 5, 5]), PATH)).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
