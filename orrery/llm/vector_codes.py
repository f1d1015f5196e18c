"""Vector code compression: a byte for each part of a vector, the nearest entry of that part's codebook, found by exponion search.

Components become integers, floor(scale * x), and all that follows is exact integer arithmetic. A vector is cut into
consecutive parts; each part's codebook starts as that part of the vectors of the smallest ids. A round assigns every
part to its nearest entry (least squared distance, then least index) and puts each entry at the floor of its parts'
mean; entries without parts stay.

Exponion search: a part starts at its previous entry a, at distance d. An entry further than 2 d from a is further than
d from the part, so only entries j with D(a, j)^2 <= 4 d^2 are compared: the beginning of a's list of all other
entries sorted by their distance from it. Equal distances lie inside, so ties are found too.

Each pass is a map over the vectors, which carries the last codes with them; sums of parts by entry are made in the
tasks first and are all that is shuffled. The driver sees the codebooks only (entries * dimensions numbers).

Cases: vectors that are null or hold null or non-finite components take no part, nor do vectors of another length than
that of the smallest id. Ids order by value, null last, then by vector; repeated rows count each by itself. With fewer
vectors than entries the codebooks are smaller; no vectors give no rows and empty codebooks. A length that parts don't
divide is cut as evenly as it can be. Components of any finite size are exact; an error beyond 64 bits is the largest
such integer. Further columns of any name pass through in row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, mapped, written

#: Parts of a vector, entries of a codebook (256 at most: a code is a byte), rounds, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components that are worked on at once.
BLOCK = 1 << 20
#: Labels whose sums are broadcast at most; more are joined by a shuffle.
LABELS = 1 << 16
#: The largest long.
MOST = 2**63 - 1

#: Of each part, its entries' components.
Codebooks = list[list[tuple[int, ...]]]


def cuts(size: int, parts: int) -> list[slice]:
    return [slice(size * p // parts, size * (p + 1) // parts) for p in range(parts)]


def whole(vectors: np.ndarray, scale: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(integers, large): floor(scale * x) of each row's components as int64, and which rows have one of `bound` or more (theirs are 0)."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(scale))
    large = (np.abs(scaled) >= bound).any(axis=1)
    return np.where(large[:, None], 0, scaled).astype(np.int64), large


def exact(vector: np.ndarray, scale: int) -> list[int]:
    return [math.floor(Fraction(x) * scale) for x in vector.tolist()]


def scan(x: np.ndarray, start: np.ndarray, entries: np.ndarray, near: np.ndarray, spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry. near: of each entry the others by distance; spans: these squared distances."""
    gap = x - entries[start]
    first = (gap * gap).sum(axis=1)
    index, best = start.copy(), first.copy()
    within = np.zeros(len(x), np.int64)
    for a in np.unique(start):
        mine = np.nonzero(start == a)[0]
        within[mine] = np.searchsorted(spans[a], 4 * first[mine], side="right")
    order = np.argsort(-within, kind="stable")  # those that go furthest first, so that each step is a beginning of them
    reach = -within[order]
    for step in range(-reach[0] if len(reach) else 0):
        rows = order[: np.searchsorted(reach, -step, side="left")]
        others = near[start[rows], step]
        gap = x[rows] - entries[others]
        far = (gap * gap).sum(axis=1)
        better = (far < best[rows]) | ((far == best[rows]) & (others < index[rows]))
        rows, others, far = rows[better], others[better], far[better]
        index[rows], best[rows] = others, far
    return index, best


class Book:
    """A part's entries and the neighbour lists that a scan needs."""

    def __init__(self, entries: list[tuple[int, ...]], bound: int) -> None:
        self.entries = np.array(entries, dtype=object).reshape(len(entries), -1)
        self.small = np.array([all(-bound < c < bound for c in e) for e in entries], bool)
        self.numbers = np.where(self.small[:, None], self.entries, 0).astype(np.int64)
        gaps = self.entries[:, None, :] - self.entries[None, :, :] if not self.small.all() else self.numbers[:, None, :] - self.numbers[None, :, :]
        squares = (gaps * gaps).sum(axis=2)
        lists = [sorted((j for j in range(len(entries)) if j != a), key=lambda j, a=a: (squares[a, j], j)) for a in range(len(entries))]
        self.near = np.array(lists, np.int64).reshape(len(entries), -1)
        self.wide = [np.array([squares[a, j] for j in line], dtype=object) for a, line in enumerate(lists)]
        self.spans = [np.array([min(int(s), MOST) for s in line], np.int64) for line in self.wide]

    def assign(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of small integers. Those that were at an entry too large for 64 bits start at the first that is not."""
        return scan(x, np.where(self.small[start], start, self.small.argmax()), self.numbers, self.near, self.spans)

    def assign_wide(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of any integers."""
        return scan(x, start, self.entries, self.near, self.wide)


def bound_of(size: int) -> int:
    """Vectors of integers below this have squared distances of which four times as much fits into 64 bits."""
    return math.isqrt((1 << 59) // max(1, size))


def blocks(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors) of about BLOCK components at once."""
    n, step = len(column), max(1, BLOCK // max(1, size))
    values = np.asarray(column.flatten(), np.float64).reshape(n, size)
    for start in range(0, n, step):
        yield start, values[start : start + step]


def assigned(rows: DataFrame, codebooks: Codebooks, size: int, scale: int) -> DataFrame:
    """row, vector, code and error of rows, which have row, vector and code (of the pass before; null: none)."""
    parts = cuts(size, len(codebooks))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = bound_of(size)
        books = [Book(entries, bound) for entries in codebooks]
        no_small = any(not book.small.any() for book in books)
        for batch in batches:
            before = [np.frombuffer(c, np.uint8) if c else np.zeros(len(parts), np.uint8) for c in batch.column(2).to_pylist()]
            starts = np.array(before, np.int64).reshape(batch.num_rows, len(parts))
            codes, errors = np.zeros((batch.num_rows, len(parts)), np.uint8), np.zeros(batch.num_rows, np.int64)
            for at, vectors in blocks(batch.column(1), size):
                numbers, large = whole(vectors, scale, bound)
                small, wide = np.nonzero(~(large | no_small))[0], np.nonzero(large | no_small)[0]
                exacts = np.array([exact(vectors[k], scale) for k in wide], dtype=object).reshape(len(wide), size)
                total, total_wide = np.zeros(len(small), np.int64), np.zeros(len(wide), object)
                for p, cut in enumerate(parts):
                    codes[at + small, p], far = books[p].assign(numbers[small, cut], starts[at + small, p])
                    total += far
                    if len(wide):
                        codes[at + wide, p], far = books[p].assign_wide(exacts[:, cut], starts[at + wide, p])
                        total_wide += far
                errors[at + small] = total
                errors[at + wide] = [min(int(e), MOST) for e in total_wide]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.int64())], names=["row", "vector", "code", "error"])

    return mapped(rows, assign, "vector array<double>, code binary, error long")


def means(rows: DataFrame, codebooks: Codebooks, size: int, scale: int) -> Codebooks:
    """Codebooks with each entry at the floor of the mean of the parts that are coded by it; others stay."""
    parts, entries = cuts(size, len(codebooks)), len(codebooks[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = bound_of(size)
        counts, sums = np.zeros((len(parts), entries), np.int64), np.zeros((entries, size), object)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, len(parts))
            for at, vectors in blocks(batch.column(0), size):
                numbers, large = whole(vectors, scale, bound)
                mine, part = codes[at : at + len(vectors)], np.zeros((entries, size), np.int64)
                for p, cut in enumerate(parts):
                    np.add.at(part[:, cut], mine[:, p], numbers[:, cut])
                    counts[p] += np.bincount(mine[:, p], minlength=entries)
                sums += part.astype(object)
                for k in np.nonzero(large)[0]:
                    values = exact(vectors[k], scale)
                    for p, cut in enumerate(parts):
                        sums[mine[k, p], cut] += np.array(values[cut], dtype=object)
        of = [(e, p, -1, 0, int(counts[p, e])) for p in range(len(parts)) for e in range(entries) if counts[p, e]]
        for p, cut in enumerate(parts):  # sums of any size go as limbs of 32 bits
            for e in np.nonzero(counts[p])[0]:
                for place, value in enumerate(sums[e, cut]):
                    limb = 0
                    while value not in (0, -1) or not limb:
                        of.append((int(e), p, place, limb, int(value) & 0xFFFFFFFF))
                        value, limb = int(value) >> 32, limb + 1
                    if value:
                        of.append((int(e), p, place, limb, -1))
        if of:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*of, strict=True)], names=["entry", "part", "place", "limb", "value"])

    found = rows.select("vector", "code").mapInArrow(add, "entry long, part long, place long, limb long, value long").groupBy("entry", "part", "place", "limb").agg(F.sum("value").alias("value"))
    totals: dict[tuple[int, int, int], int] = {}
    for r in found.collect():  # of codebooks: entries * dimensions numbers of a few limbs
        key = (r["part"], r["entry"], r["place"])
        totals[key] = totals.get(key, 0) + (r["value"] << (32 * r["limb"]))
    return [[tuple(totals[p, e, k] // n for k in range(len(entry))) if (n := totals.get((p, e, -1))) else entry for e, entry in enumerate(book)] for p, book in enumerate(codebooks)]


def encoded(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """(rows, codebooks). rows: row, code (binary, an index for each part) and error (squared distances summed over parts) of every vector that takes part."""
    if not 1 <= entries <= 256:
        raise ValueError("A codebook has 1 to 256 entries: a code is a byte.")
    fine = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = carried(df, list(dict.fromkeys([*(keep or df.columns), id_col])), vector=F.col(f"`{vector_col}`").cast("array<double>")).filter(F.col("vector").isNotNull() & fine)
    by_id = (F.col(f"row.`{id_col}`").asc_nulls_last(), "vector")
    seeds = rows.select("row", "vector").orderBy(*by_id).limit(entries).select("vector").collect()
    size = len(seeds[0]["vector"]) if seeds else 0
    rows = rows.filter(F.size("vector") == size)
    if any(len(r["vector"]) != size for r in seeds):
        seeds = rows.orderBy(*by_id).limit(entries).select("vector").collect()
    starts = [exact(np.array(r["vector"], np.float64), scale) for r in seeds]
    codebooks: Codebooks = [[tuple(s[cut]) for s in starts] for cut in cuts(size, parts)]
    if not starts:
        return rows.select("row", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")).filter("false"), codebooks
    rows = rows.withColumn("code", F.lit(None).cast("binary"))
    for _ in range(rounds):
        rows = written(assigned(rows, codebooks, size, scale).drop("error"))
        codebooks = means(rows, codebooks, size, scale)
    return written(assigned(rows, codebooks, size, scale).drop("vector")), codebooks


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components by part, entry and place, as decimals with commas between."""
    return hashlib.sha256(",".join(str(c) for book in codebooks for entry in book for c in entry).encode()).hexdigest()


def with_label_error(rows: DataFrame, label: str, labels: int = LABELS) -> DataFrame:
    """rows (label, error, ...) with label_error: error summed over the rows of equal label, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    totals = written(rows.groupBy(F.col(label).alias("of_label")).agg(total.alias("label_error")))
    few = totals.limit(labels + 1).count() <= labels
    return rows.join(F.broadcast(totals) if few else totals, F.col(label).eqNullSafe(F.col("of_label")), "left").drop("of_label")
