from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import ODD
from tokenizers import Tokenizer

from orrery.llm import bpe

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [*ODD, "don't we'll <|endoftext|> x<|endoftext|>", "a\n\n\nb  \t c", "x" * 70 + " " + "!" * 200, "١٢٣ ½ Ⅷ", "é" * 300, " lead", "trail "]


def test_as_the_library_does(spark, make_docs):
    known = Tokenizer.from_file(PATH)
    out = bpe.encoded(make_docs(TEXTS), PATH).collect()
    assert [r["row"]["doc_id"] for r in out] == list(range(len(TEXTS)))
    for r, text in zip(out, TEXTS, strict=True):
        ids = known.encode(text or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
    back = bpe.decoded(bpe.encoded(make_docs(TEXTS), PATH, packed=True), PATH).collect()
    assert [r["text"] for r in back] == [t or "" for t in TEXTS]
    assert bpe.encoded(make_docs([]), PATH).count() == 0


def test_null_ids_and_repeated_rows(spark, make_docs):
    texts, ids = ["a b", "a b", "a b", None, None, "don't"], [None, 4, 4, None, None, 4]
    known = Tokenizer.from_file(PATH)
    got = bpe.encoded(make_docs(texts, ids), PATH).collect()
    want = [(i, t, known.encode(t or "", add_special_tokens=False).ids) for i, t in zip(ids, texts, strict=True)]
    assert sorted(((r["row"]["doc_id"], r["row"]["text"], r["ids"]) for r in got), key=repr) == sorted(want, key=repr)


def test_bytes_that_are_no_text_are_replaced(spark):
    df = spark.createDataFrame([(1, [0, 1, 50256]), (2, [160]), (3, None), (4, [])], "n int, ids array<int>")
    known = Tokenizer.from_file(PATH)
    assert [r["text"] for r in bpe.decoded(df, PATH).collect()] == [known.decode(x or [], skip_special_tokens=False) for x in ([0, 1, 50256], [160], None, [])]


def test_short_long_and_cut_texts_agree(monkeypatch):
    known = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    words = [b"thnatever", b"ab" * 30, b"x", b"\xff\xfe" * 20, b"international" * 4]
    assert known.merged_short(words, 64) == [known.merged_long(w) for w in words]
    whole = list(known.encode_batch(TEXTS))
    monkeypatch.setattr(bpe, "SPAN", 50)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    fresh = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    assert list(fresh.encode_batch(TEXTS)) == whole and len(fresh.known) <= 3


@pytest.mark.parametrize("seed", range(3))
def test_merges_against_a_plain_loop(seed):
    known = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    rng = np.random.default_rng(seed)
    word = bytes(rng.choice(list(b"thenatiorsl"), 60).tolist())
    ids = known.first[np.frombuffer(word, np.uint8)].tolist()
    while True:
        ranks = [(known.pairs.get(a << 32 | b, 1 << 60), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
        if not ranks or min(ranks)[0] == 1 << 60:
            break
        rank, k = min(ranks)
        ids[k : k + 2] = [int(known.joined[rank])]
    assert known.merged_long(word) == np.array(ids, "<u4").tobytes() == known.merged_short([word], 64)[0]
