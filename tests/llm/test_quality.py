from __future__ import annotations

import os
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, prose
from pyspark.sql import functions as F

from orrery.llm import queries, quality_classifier, quality_rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_and_verdicts(spark, make_docs):
    texts = [*ODD, "x\ny\nx\n\n \nx", "a b c a b c d", " lead\x0b\x0c", *(prose(k, 60 + k, 50) for k in range(12)), "\n".join([prose(3, 20)] * 4), "A B C " * 30]
    docs = make_docs(texts)
    trusted = docs.filter("doc_id >= 11").select("doc_id")
    got = quality_rules.judged(docs, trusted).collect()
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got] == [counts(t) for t in texts]
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    none = quality_rules.judged(docs, trusted.limit(0)).collect()
    assert all(r["score"] == 0 and r["kept"] == (not r["base_failed"]) for r in none)
    kept = quality_rules.kept_documents(docs, trusted)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["row"]["doc_id"] for r in got if r["kept"])
    assert quality_rules.judged(docs.limit(0), trusted).count() == 0


def test_ratio_by_hand(spark, make_docs):
    import math

    docs = make_docs(["a a b", "a c"])
    got = {r["row"]["doc_id"]: r["score"] for r in quality_rules.judged(docs, docs.filter("doc_id = 0").select("doc_id"), smoothing=1.0).collect()}
    one, two = ["a", "a", "b", "aa", "ab"], ["a", "c", "ac"]
    raw, good = Counter(one + two), Counter(one)
    ratio = lambda g: math.log((good[g] + 1) / (raw[g] * 5 / 8 + 1))
    assert got == pytest.approx({0: sum(map(ratio, one)) / 5, 1: sum(map(ratio, two)) / 3})


def test_all_trusted_documents_count(spark, make_docs):
    """With all of many documents trusted both multinomials are the same, and every score is 0."""
    docs = make_docs([f"w{k % 977} v{k % 31}" for k in range(20_100)])
    assert {r["score"] for r in quality_rules.judged(docs, docs.select("doc_id")).select("score").distinct().collect()} == {0.0}


def test_junk_scores_lower(spark, make_docs):
    good, junk = [prose(k, 150) for k in range(40)], [re.sub(r"w(\d)", r"#\1 |", prose(k, 150)) for k in range(8)]
    got = quality_rules.judged(make_docs(good + junk), make_docs(good).select("doc_id")).collect()
    assert min(r["score"] for r in got[:40]) > max(r["score"] for r in got[40:]) and not any(r["kept"] for r in got[40:])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables are not here")
def test_classifier_on_held_out_labels(spark):
    out = queries.op6_quality_classifier(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    both = out[out.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.98 and out.score.between(0, 1).all()
    assert (both[both.quality == 1].predicted == 1).mean() > 0.99


def test_classifier_cases(spark, make_docs):
    docs = make_docs(ODD)
    labels = lambda *v: spark.createDataFrame(list(v), "doc_id long, quality int")
    run = lambda d, lab: [r["score"] for r in quality_classifier.scored(d, docs, lab).collect()]
    assert set(run(docs, labels())) == {0.5}
    assert set(run(docs, labels((5, 1), (6, 1)))) == {1.0}
    found = run(docs, labels((5, 1), (8, 0), (9, 1), (0, 1), (99, 0), (7, None)))
    assert len(found) == len(ODD) and all(0 <= s <= 1 for s in found) and found[5] > found[8] and found[0] == found[1] == found[2]
    assert run(docs, labels((5, 1), (8, 0), (9, 1))) == run(docs, labels((9, 1), (8, 0), (5, 1)))
    assert run(docs.limit(0), labels((5, 1), (8, 0))) == []
    kept = quality_classifier.kept_documents(docs, docs, labels((5, 1), (8, 0), (9, 1)))
    assert kept.columns == docs.columns


def brute_scores(texts, sample, labels, rank=quality_classifier.RANK, k=quality_classifier.NEIGHBOURS):
    """Scores from a singular value decomposition of the sample's whole term matrix and a sort of all cosines."""

    def vector(text):
        out = np.zeros(quality_classifier.TERMS)
        at, values = quality_classifier.terms((text or "").encode())
        out[at] = values
        return out

    x = np.array([vector(t) for t in sample])
    used = (x > 0).any(axis=0)
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    _, s, v = np.linalg.svd(unit(x * weight)[:, used], full_matrices=False)
    v = v[: min(rank, (s**2 > 1e-10).sum())]
    known = unit(x * weight)[:, used] @ v.T
    out = []
    for t in texts:
        own = (vector(t) * weight)[used] @ v.T
        if np.linalg.norm(own) <= 1e-12:
            out.append(float(np.mean(labels)))
            continue
        near = np.round(unit(known) @ (own / np.linalg.norm(own)), 9)
        best = sorted(range(len(sample)), key=lambda j: (-near[j], j))[:k]
        votes = [max(near[j], 1e-9) ** 4 for j in best]
        out.append(sum(w * labels[j] for w, j in zip(votes, best, strict=True)) / sum(votes))
    return out


def test_classifier_against_brute_force(spark, make_docs):
    texts = [*ODD, *(prose(k, 30 + k) for k in range(25)), *(re.sub(r"w(\d)", r"#\1 |", prose(k, 40 + k)) for k in range(15)), *[prose(5, 35)] * 8]
    ids = list(range(len(texts)))
    docs = make_docs(texts, ids)
    labels = {i: (i * 7) % 3 % 2 for i in ids if i % 2 or i > 45}  # equal texts with labels of both kinds
    order = [r["doc_id"] for r in docs.filter("text is not null").orderBy(F.xxhash64("doc_id")).collect() if r["doc_id"] in labels]
    got = quality_classifier.scored(docs, docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()
    want = brute_scores(texts, [texts[i] for i in order], [labels[i] for i in order])
    assert [r["row"]["doc_id"] for r in got] == ids and [r["score"] for r in got] == pytest.approx(want, abs=1e-5)


def test_classifier_null_and_repeated_ids(spark, make_docs):
    """A row is scored for its text alone; one text of an id that many rows have is fitted."""
    docs = make_docs([prose(1, 60), "# | # |", prose(1, 60), prose(2, 60), *["long " * 50] * 40], [None, 1, None, 2, *[3] * 40])
    got = quality_classifier.scored(docs, docs, spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int"), neighbours=1).collect()
    assert [r["score"] for r in got] == [1, 0, 1, 1] + [1] * 40
    texts, labels = quality_classifier.sampled(docs, spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int"), F.col("quality"), "doc_id", "text", 2000)
    assert len(texts) == 3 and sorted(labels) == [0, 1, 1]


def test_nearest_of_equal_ones_are_the_first():
    near = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [1, 1, 1, 1, 1], [0, 0, 0, 0, 2]])
    assert quality_classifier.nearest(near, 3).tolist() == [[True, True, True, False, False], [True, True, True, False, False], [True, True, False, False, True]]
    assert quality_classifier.nearest(near, 9).all()


def test_rules_null_and_repeated_ids(spark, make_docs):
    """Each row is judged by its own text; all rows of a trusted id are trusted, a null id is not."""
    docs = make_docs(["a b", "a b", "a b", "c d"], [None, 1, 1, 2])
    ids = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    got = quality_rules.judged(docs, ids, smoothing=1.0).collect()
    raw, good = {"a": 3, "c": 1}, {"a": 2, "c": 0}
    want = [float(np.log((good[g] + 1) / (raw[g] * 6 / 12 + 1))) for g in "aaac"]  # both words and the pair of a text occur alike
    assert [r["score"] for r in got] == pytest.approx(want) and [r["row"]["doc_id"] for r in got] == [None, 1, 1, 2]
    assert all(r["base_failed"] and not r["kept"] for r in got)


@pytest.mark.parametrize(("n", "terms", "rank"), [(300, 120, 40), (30, 200, 96), (7, 3, 5)])
def test_leading_vectors(n, terms, rank):
    x = np.random.default_rng(n).random((n, terms)) ** 4
    _, sizes, _ = np.linalg.svd(x)
    squares, vectors = quality_classifier.leading(x @ x.T, rank)
    assert np.allclose(squares, sizes[:rank] ** 2)
    assert np.allclose(vectors.T @ vectors, np.eye(len(squares)))
    assert np.abs(x @ x.T @ vectors - vectors * squares).max() <= 1e-3 * squares[0]


def peak(f, *args) -> int:
    """Bytes that f takes at most besides what there was before."""
    tracemalloc.start()
    try:
        f(*args)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_terms_of_a_long_text_take_little_memory():
    """A text's bytes and words are not all held as numbers and objects at once."""
    text = "\n".join(prose(k, 1000) for k in range(1300)).encode()
    assert len(text) > 4_000_000 and peak(quality_classifier.terms, text) < 6 * len(text)


@pytest.mark.parametrize("span", [1, 2, 3, 7, 50])
def test_terms_by_spans(span):
    rng = random.Random(span)
    texts = [t.encode() for t in ODD if t] + [bytes(rng.choice(b"aAb#|\n\t \x0b\x0c\r\xc3\xa9\x1c") for _ in range(rng.randrange(80))) for _ in range(300)]
    for text in texts:
        words, lines = text.split(), text.split(b"\n")
        at, values = quality_classifier.terms(text, span)
        if not words:
            assert len(at) == len(values) == 0
            continue
        pairs = Counter(a << 8 | b for a, b in zip(text, text[1:], strict=False))
        known = at < quality_classifier.PAIRS
        assert dict(zip(at[known].tolist(), values[known].tolist(), strict=True)) == pytest.approx({p: (n / (len(text) - 1)) ** 0.5 for p, n in pairs.items()})
        n = len(words)
        want = [sum(map(bytes.__eq__, words[1:], words)) / n, 1 - len(set(words)) / n, 1 - len(set(lines)) / len(lines), sum(map(bytes.isupper, words)) / n, 1 - sum(map(bytes.isalnum, words)) / n, sum(not w.strip(quality_classifier.SIGNS) for w in words) / n]
        assert quality_classifier.shape(text, span) == want
