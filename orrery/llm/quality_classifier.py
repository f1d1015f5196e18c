"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space.

A document is a bag of terms: pairs of bytes of its text, which tell scripts, casing, signs and tables apart, and
terms of its shape (shares of repeated words, repeated lines, words in capitals and words of signs, in steps). A bounded
sample of labelled documents is fitted: the terms' weights, a truncated singular value decomposition of the sample's
term matrix, and the sample's own latent vectors with their labels. That model is broadcast; its size is bounded by
SAMPLE and RANK. Every document, whole, is folded into the space, and its cosines with all labelled vectors are exact
products of blocks; the labels of the NEIGHBOURS nearest vote with the weight of their similarity.

Cases: a null or empty text has no terms, a zero vector, and the share of label 1 in the sample as its score. Ties
among neighbours (cosines equal to 9 digits): smaller position in the sample, which is in the order of the ids' hashes. Without labelled rows, or with those of one label, the score is
that label's (0.5 without any). Repeated rows, null ids and further columns of any name pass through in row; no rows
give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LINE_END, SPACE, carried, mapped, pieces, written

#: Labelled documents that are fitted at most: those with the smallest hashes of their id.
SAMPLE = 2000
#: Bytes of those documents in all at most, going by the hashes; one that does not fit in is left out. Keeps the driver's share bounded.
SAMPLE_CHARS = 20_000_000
#: Dimensions of the latent space, and neighbours that vote.
RANK, NEIGHBOURS = 96, 15
#: Terms: pairs of bytes, then steps of shares.
PAIRS, STEPS, SHAPES = 1 << 16, 21, 6
TERMS = PAIRS + STEPS * SHAPES
#: ASCII signs.
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Weight of a shape term against a document's pairs of bytes, which together weigh 1.
SHAPE_WEIGHT = 0.2
#: Digits of a cosine that count.
DIGITS = 9
#: Score that a document of good quality has at least.
LEAST = 0.3
#: Bytes of one text that are counted at once, about. Besides these its distinct words and lines are held.
SPAN = 1 << 18
#: Documents whose products are computed at once, and terms of the sample that are held at once while it is fitted.
BLOCK, FIT_TERMS = 256, 512
#: The decomposition: dimensions besides RANK that are carried along, and rounds at most.
SPARE, ROUNDS = 32, 200


def shape(text: bytes, span: int = SPAN) -> list[float]:
    """Shares that tell ordered prose from junk; the text has a word."""
    n = again = capitals = plain = bare = 0
    last, distinct, lines = None, set(), set()
    for piece in pieces(text, span, SPACE):
        words = piece.split()
        n += len(words)
        again += sum(a == b for a, b in zip(words, words[1:], strict=False)) + (words[:1] == [last])
        capitals += sum(map(bytes.isupper, words))
        plain += sum(map(bytes.isalnum, words))
        bare += sum(1 for w in words if not w.strip(SIGNS))
        distinct.update(words)
        last = words[-1] if words else last
    for piece in pieces(text, span, LINE_END):
        lines.update(piece.split(b"\n"))
    return [again / n, 1 - len(distinct) / n, 1 - len(lines) / (text.count(b"\n") + 1), capitals / n, 1 - plain / n, bare / n]


def pair_counts(text: bytes, span: int = SPAN) -> np.ndarray:
    """How often each pair of bytes occurs."""
    counts = np.zeros(0, np.int64)
    for start in range(0, max(1, len(text) - 1), span):
        raw = np.frombuffer(text[start : start + span + 1], np.uint8).astype(np.int64)
        part = np.bincount(raw[:-1] << 8 | raw[1:], minlength=PAIRS)
        counts = counts + part if start else part
    return counts


def terms(text: bytes | None, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a text and their counts; the counts of pairs of bytes are square roots of shares."""
    text = text or b""
    if not text or text.isspace():
        return np.zeros(0, np.int64), np.zeros(0)
    counts = pair_counts(text, span)
    pairs = np.nonzero(counts)[0]
    counts = counts[pairs]
    shares = np.array(shape(text, span))
    steps = np.nonzero(np.arange(STEPS) <= shares[:, None] * (STEPS - 1) + 0.5)  # near shares have most steps in common
    return np.concatenate([pairs, PAIRS + steps[0] * STEPS + steps[1]]), np.concatenate([np.sqrt(counts / max(1, counts.sum())), np.full(len(steps[0]), SHAPE_WEIGHT)])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading(products: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, at most rank of them and none of zero, and their vectors: subspace iteration, until they stand still."""
    n = len(products)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((n, min(n, rank + SPARE))))[0]
    squares = np.full(min(n, rank), np.inf)
    for _ in range(ROUNDS):
        last, image = squares, products @ basis
        squares, turn = np.linalg.eigh(basis.T @ image)
        squares, vectors = squares[::-1][:rank], basis @ turn[:, ::-1][:, :rank]
        if np.abs(squares - last).max() <= 1e-9 * squares[0]:
            break
        basis = np.linalg.qr(image)[0]
    kept = squares > 1e-10
    return squares[kept], vectors[:, kept]


def fitted(texts: list[bytes | None], labels: list[int], rank: int) -> dict:
    """Terms in use, their weights, the projection, and the sample's vectors and labels.

    The decomposition is taken from the sample's matrix of inner products; the term matrix itself is only held a block
    of terms at a time.
    """
    rows = [terms(t) for t in texts]
    used, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *(r[0] for r in rows)]), return_counts=True)
    place = np.full(TERMS, -1, np.int64)
    place[used] = np.arange(len(used))
    weights = np.log((1 + len(rows)) / (1 + counts)) + 1
    whose = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t, _ in rows])
    at = place.astype(np.int32)[np.concatenate([np.zeros(0, np.int64), *(t for t, _ in rows)])]
    values = np.concatenate([np.zeros(0), *(c for _, c in rows)]) * weights[at]
    del rows
    values /= np.maximum(np.sqrt(np.bincount(whose, values * values, minlength=len(texts))), 1e-12)[whose]
    order = np.argsort(at, kind="stable")
    whose, at, values = whose[order], at[order], values[order]

    def by_terms() -> Iterator[np.ndarray]:
        for first in range(0, len(used), FIT_TERMS):
            a, z = np.searchsorted(at, [first, first + FIT_TERMS])
            part = np.zeros((len(texts), min(FIT_TERMS, len(used) - first)))
            part[whose[a:z], at[a:z] - first] = values[a:z]
            yield part

    products = np.zeros((len(texts), len(texts)))
    for part in by_terms():
        products += part @ part.T
    squares, left = leading(products, rank)
    del products
    sizes = np.sqrt(squares)
    projection = np.concatenate([np.zeros((0, len(sizes))), *(part.T @ left / sizes for part in by_terms())])
    return {"place": place, "weights": weights, "projection": projection.astype(np.float32), "vectors": unit(left * sizes), "labels": np.array(labels, dtype=float)}


def scores(model: dict, texts: list[bytes | None], neighbours: int) -> np.ndarray:
    labels = model["labels"]
    known = np.zeros((len(texts), model["projection"].shape[1]))
    for k, t in enumerate(texts):
        at, c = terms(t)
        at = model["place"][at]
        at, c = at[at >= 0], c[at >= 0]
        known[k] = (c * model["weights"][at]) @ model["projection"][at]
    has = np.linalg.norm(known, axis=1) > 1e-12
    near = np.round(unit(known) @ model["vectors"].T, DIGITS)
    weight = np.where(nearest(near, neighbours), np.maximum(near, 1e-9) ** 4, 0.0)
    return np.where(has, np.clip(weight @ labels / weight.sum(axis=1), 0, 1), labels.mean())


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Which values are among the k largest of their row; of equal ones the first."""
    if k >= near.shape[1]:
        return np.ones(near.shape, bool)
    last = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    more, same = near > last, near == last
    return more | same & (np.cumsum(same, axis=1) <= k - more.sum(axis=1, keepdims=True))


def sampled(docs: DataFrame, labels: DataFrame, label: Column, id_col: str, text_col: str, sample: int) -> tuple[list, list]:
    """Texts and labels of the sample, in the order of their ids' hashes."""
    chosen = labels.select(F.col(id_col).alias("of"), label.cast("int").alias("label")).dropna().orderBy(F.xxhash64("of"), "of", "label").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).filter("text is not null").join(F.broadcast(chosen), F.col("id") == F.col("of"))
    # one text of each id, whatever number of rows has it
    texts = written(texts.groupBy("id", "label").agg(F.min("text").alias("text")).select(F.xxhash64("id").alias("h"), "id", "label", F.length("text").alias("n"), "text"))
    fit, total = [], 0
    for r in sorted(texts.select("h", "id", "label", "n").collect(), key=lambda r: (r["h"], r["id"], r["label"])):  # `sample` rows at most
        if total + r["n"] <= SAMPLE_CHARS:
            fit.append(r["id"])
            total += r["n"]
    rows = texts.filter(F.col("id").isin(fit)).collect() if fit else []
    rows.sort(key=lambda r: (r["h"], r["id"], r["label"]))
    return [bytes(r["text"]) for r in rows], [r["label"] for r in rows]


def scored(docs: DataFrame, labelled: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, rank: int = RANK, neighbours: int = NEIGHBOURS, sample: int = SAMPLE) -> DataFrame:
    """row and score (0 to 1, likelihood of label 1) of every document of docs.

    labelled: the documents whose texts labels (id_col, label_col of 0 and 1) tells about, at most `sample` of which
    are fitted on the driver.
    """
    texts, values = sampled(labelled, labels, F.col(label_col), id_col, text_col, sample)
    constant = None if len(set(values)) > 1 else float(values[0]) if values else 0.5
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fitted(texts, values, rank)) if constant is None else b"")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = pickle.loads(model.value) if constant is None else {}  # for this task only: idle workers hold none
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.column(1).slice(start, BLOCK).to_pylist()
                out.append(scores(opened, part, neighbours) if constant is None else np.full(len(part), constant))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *out]))], names=["row", "score"])

    return mapped(carried(docs, keep, text=F.col(text_col).cast("binary")), score, "score double")


def kept_documents(docs: DataFrame, labelled: DataFrame, labels: DataFrame, least: float = LEAST, **how: object) -> DataFrame:
    """The documents whose score is at least `least`, with the columns they came with."""
    return scored(docs, labelled, labels, **how).filter(F.col("score") >= least).select("row.*")
