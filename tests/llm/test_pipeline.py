from __future__ import annotations

import math
import os
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest_llm import ODD, prose
from test_near_dup import brute as brute_near
from test_near_dup import edited
from test_quality import brute_scores, counts
from test_substring import brute as brute_substring

import corpus_pipeline
from orrery.llm import quality_rules
from orrery.llm.common import table
from orrery.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(seen[1]) <= set(seen[0]) and set(seen[2]) <= set(seen[1]) and set(seen[3]) == set(seen[2]) and seen[0]
    assert all(seen[3][i] == t or len(seen[3][i].split()) < len(t.split()) for i, t in seen[2].items())
    ended = {r["doc_id"] for r in docs.collect()}
    assert ended == set(seen[3])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == ended


def brute_rules(texts, trusted):
    """Whether the rules keep each text: counts in Python, and ratios of n-grams hashed as Spark's xxhash64 does."""
    signed = lambda x: x - (x >> 63 << 64)
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42)))
    grams = []
    for t in texts:
        h = [word(w) for w in (t or "").split()]
        grams.append([x % quality_rules.BUCKETS for x in [*h, *map(pair, h, h[1:])]])
    raw, good = Counter(g for gs in grams for g in gs), Counter(g for gs, fine in zip(grams, trusted, strict=True) if fine for g in gs)
    share, s = sum(good.values()) / sum(raw.values()), quality_rules.SMOOTHING
    scores = [sum(math.log((good[g] + s) / (raw[g] * share + s)) for g in gs) / len(gs) if gs else 0 for gs in grams]
    return [not counts(t)[-1] and x >= quality_rules.THRESHOLD for t, x in zip(texts, scores, strict=True)]


def test_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    passage = prose(77, 40, 3000)
    texts = [None, "", "short one", "again and again " * 40]
    texts += [f"{prose(k, 80 + k, 3000)} {passage if k % 3 == 0 else ''}" for k in range(40)]
    texts += [edited(texts[4 + k], k, 0.01) for k in range(12)] + [texts[9]] * 3
    texts += [" ".join(f"#{w} |" if rng.random() < 0.5 else w.upper() for w in prose(300 + k, 90, 3000).split()) for k in range(14)]
    texts += [prose(900, 6000, 3000)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    junk = {i for i, t in zip(ids, texts, strict=True) if t and "|" in t}
    labels = {i: int(i not in junk) for i in ids if i % 3}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    text_of = dict(zip(ids, texts, strict=True))
    kept = [i for i, fine in zip(ids, brute_rules(texts, [labels.get(i) == 1 for i in ids]), strict=True) if fine]
    assert 0 < len(kept) < len(ids) and junk - set(kept)
    learned = sorted((signed_hash(i), i) for i in labels if zlib.crc32(str(i).encode()) % 5 and text_of[i] is not None)
    scores = brute_scores([text_of[i] for i in kept], [text_of[i] for _, i in learned], [labels[i] for _, i in learned])
    kept = [i for i, s in zip(kept, scores, strict=True) if s >= 0.3]
    near = brute_near([text_of[i] for i in kept], kept, 5)
    kept = [i for i, _, _, stays in near if stays]
    cut = {i: (text_of[i] if not gone else left) for i, _, gone, left in brute_substring([text_of[i] for i in kept], kept)}
    assert len(near) > len(kept) and any(cut[i] != text_of[i] for i in kept)
    tokens, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), []
    for i, t in cut.items():
        found = [*tokens.encode(t, add_special_tokens=False).ids, 1]
        for p, start in enumerate(range(0, len(found), 4096)):
            part = found[start : start + 4096]
            want.append((i, p, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    by_sequence: dict[int, list] = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    assert len(by_sequence) == -(-sum(w[3] for w in want) // 4096)


def signed_hash(i: int) -> int:
    x = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
    return x - (x >> 63 << 64)


def test_stages_on_odd_rows(spark):
    """Null ids and columns, odd texts, repeated rows, no rows, further columns of names that the stages use themselves."""
    texts = [*ODD, prose(3, 200), prose(3, 200), prose(4, 150) + " " + prose(5, 60), prose(6, 150) + " " + prose(5, 60)]
    rows = [(k if k % 4 else None, t, None, None, len(t) if t else None, "r", 1, 0.5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, lang string, source string, n_chars long, row string, id int, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        got = out.collect()
        assert name == "packing" or out.columns == docs.columns
        assert len(got) > 0 or name.startswith("quality")
        assert stage(spark, docs.limit(0), DATA).collect() == []
        if name == "substring":
            assert len(got) == docs.count() and all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in got)
