"""Exact top-k search by inner product, with MaxScore.

Terms are dimensions; a vector's posting for a term is its component, and a term's bounds in a shard are its least and
largest component there, which with a query's weight bound what the term can add to a score. Terms are taken in the
order of the range of what they can add. Given the score to beat (the k-th best so far), the terms at the end whose
ranges together cannot make up for it are non-essential: the others' postings are traversed for every vector of the
shard, then the non-essential ones are probed only for pairs of query and vector that can still compete.

Candidates are dealt to shards and queries to blocks, both of bounded size; each pair of a shard and a block is a
group of its own. Shards' results are merged by rank. Scores are exact integers: pairs whose sums 64-bit floats may not
hold are scored from limbs of LIMB bits, all of them, and ranked by the whole sum.

Cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part. An empty
vector scores 0 with all. Components may be of any finite size (those that times the scale exceed 64-bit floats, 2.8e306
here, count as non-finite). Scores beyond 64 bits are ranked exactly and returned as the largest or smallest 64-bit
integer. Where lengths differ, missing components count as 0. Equal scores: smaller id first. Rows with the query's id
are its own, and no candidates of it. Repeated rows are candidates of their own; a repeated query row counts once. Empty
tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 8192, 4096
#: Vectors that are traversed at once, and terms that are probed at once.
STEP, CHUNK = 512, 8
#: Candidates with components below the first and queries with sums of components' sizes below the second keep sums of 64-bit floats exact.
LARGEST, LARGEST_SUM = 1 << 24, 1 << 27
#: Bits of a limb, terms that are multiplied at once (so that floats hold their sum), and queries that are ranked at once.
LIMB, TERMS, RANKED = 20, 4096, 32


def quantized(vector: Column, scale: float) -> Column:
    """floor(scale * x) for each component, as a 64-bit float, which holds it exactly; null for vectors that take no part."""
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    parts = F.transform(scaled, lambda y: F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y))  # larger ones are integers already
    fine = F.forall(scaled, lambda y: F.coalesce(F.abs(y) < F.lit(float("inf")), F.lit(False)))
    return F.when(vector.isNotNull() & fine, parts)


def best_of_shard(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k best candidates of each query in a shard; ids ascend."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    least, most = np.minimum(queries * low, queries * high), np.maximum(queries * low, queries * high)
    order = np.argsort(-(most - least).mean(axis=0), kind="stable")
    vectors, queries, most, ranges = vectors[:, order], queries[:, order], most[:, order], (most - least)[:, order]
    rest = np.concatenate([np.cumsum(most[:, ::-1], axis=1)[:, ::-1], np.zeros((len(queries), 1))], axis=1)  # most that terms from t on add
    range_rest = np.concatenate([np.cumsum(ranges[:, ::-1], axis=1)[:, ::-1], np.zeros((len(queries), 1))], axis=1)
    floor = least.sum(axis=1)
    terms, beat = vectors.shape[1], np.full(len(queries), -np.inf)
    top_q, top_c, top_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(vectors), STEP):
        part = vectors[start : start + STEP]
        # the essential terms of the block of queries: those before the first place from which on no query can make up its gap
        short = (range_rest < (beat - floor)[:, None]).all(axis=0)
        t = min(terms, max(CHUNK, int(np.argmax(short)) if short.any() else terms))
        scores = part[:, :t] @ queries[:, :t].T
        for q in np.nonzero((own >= ids[start]) & (own <= ids[min(start + STEP, len(ids)) - 1]))[0]:
            scores[ids[start : start + STEP] == own[q], q] = -np.inf
        if start == 0 and len(part) > k:
            beat = np.maximum(beat, np.partition(scores + (part[:, t:] @ queries[:, t:].T), len(part) - k, axis=0)[len(part) - k] - 1)
        while t < terms and np.count_nonzero(alive := scores + rest[:, t] > beat) > 0.2 * scores.size:
            scores += part[:, t : t + CHUNK] @ queries[:, t : t + CHUNK].T
            t = min(terms, t + CHUNK)
        c, q = np.nonzero((scores + rest[:, t] > beat) if t == terms else alive)
        s = scores[c, q]
        while t < terms and len(s):
            s = s + np.einsum("ij,ij->i", part[c, t : t + CHUNK], queries[q, t : t + CHUNK])
            t = min(terms, t + CHUNK)
            go = s + rest[q, t] > beat[q]
            c, q, s = c[go], q[go], s[go]
        fine = np.isfinite(s)
        top_q, top_c, top_s = np.concatenate([top_q, q[fine]]), np.concatenate([top_c, c[fine] + start]), np.concatenate([top_s, s[fine]])
        by = np.lexsort((top_c, -top_s, top_q))
        top_q, top_c, top_s = top_q[by], top_c[by], top_s[by]
        first = np.searchsorted(top_q, top_q, side="left")
        keep = np.arange(len(top_q)) - first < k
        last = np.arange(len(top_q)) - first == k - 1
        beat[top_q[last]] = top_s[last]  # later candidates have larger ids: to beat it they need more
        top_q, top_c, top_s = top_q[keep], top_c[keep], top_s[keep]
    return top_q, top_c, top_s


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x (integers as floats) as sum of limb k times 2^(LIMB k); limbs have the sign of x."""
    out = []
    while x.any():
        high = np.trunc(x / 2.0**LIMB)
        out.append(x - high * 2.0**LIMB)
        x = high
    return out


def best_of_wide(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """As best_of_shard, for integers of any size; scores are Python's integers."""
    top_q, top_c, top_s = [], [], []
    have = limbs(vectors)
    for start in range(0, len(queries), RANKED):
        want = limbs(queries[start : start + RANKED])
        n = len(queries[start : start + RANKED])
        digits = [np.zeros((len(vectors), n), np.int64) for _ in range(len(have) + len(want) + 1)]
        for i, a in enumerate(have):
            for j, b in enumerate(want):
                for t in range(0, a.shape[1], TERMS):
                    digits[i + j] += (a[:, t : t + TERMS] @ b[:, t : t + TERMS].T).astype(np.int64)
        for low, high in zip(digits, digits[1:], strict=False):  # carries: all digits but the last become 0 to 2^LIMB - 1
            high += low >> LIMB
            low &= (1 << LIMB) - 1
        for q in range(n):
            order = np.lexsort((ids, *(-d[:, q] for d in digits)))
            order = order[ids[order] != own[start + q]][:k]
            top_q += [start + q] * len(order)
            top_c += order.tolist()
            top_s += [sum(int(d[c, q]) << LIMB * m for m, d in enumerate(digits)) for c in order]
    return np.array(top_q, np.int64), np.array(top_c, np.int64), top_s


def beyond(score: int) -> bytes:
    """What orders scores that are no 64-bit integers, among those cut to the same one; empty bytes for the others."""
    if -(1 << 63) < score < (1 << 63) - 1:
        return b""
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return raw if score > 0 else bytes(255 - b for b in raw)


def lengths(column: pa.ChunkedArray) -> np.ndarray:
    return pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()


def matrix(column: pa.ChunkedArray, terms: int) -> np.ndarray:
    """A row for each list, filled up with zeros; a null list is all zeros."""
    out = np.zeros((len(column), terms))
    out[np.arange(terms) < lengths(column)[:, None]] = column.combine_chunks().flatten().to_numpy()
    return out


def searched(vectors: DataFrame, is_query: Column, k: int, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score: the k best rows for each row that is_query holds for, against all other rows."""
    ship(vectors.sparkSession)
    all_rows = vectors.withColumn("is_query", is_query).select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("parts"), F.coalesce("is_query", F.lit(False)).alias("is_query"))
    # what is shuffled: 32-bit floats where they hold all components exactly
    small = F.when(F.forall("parts", lambda y: F.abs(y) < LARGEST), F.col("parts").cast("array<float>"))
    all_rows = all_rows.filter("id is not null and parts is not null").select("id", "is_query", small.alias("small"), F.when(small.isNull(), F.col("parts")).alias("large"))
    n = all_rows.agg(F.count("*").alias("rows"), F.count_if("is_query").alias("queries")).first()
    shards, blocks = -(-n["rows"] // SHARD) or 1, -(-n["queries"] // BLOCK) or 1
    place = F.xxhash64(F.spark_partition_id(), "id", "small", "large")  # rows of one id or vector spread by partitions
    candidates = all_rows.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), "id", "small", "large")
    candidates = candidates.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "small", "large")
    queries = all_rows.filter("is_query").select("id", "small", "large").distinct().select(F.xxhash64("id", "small", "large").alias("query"), "id", "small", "large")
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod("query", F.lit(blocks)).cast("int").alias("block"), "query", "id", "small", "large")

    def score(have: pa.Table, want: pa.Table) -> pa.Table:
        terms = max(1, *(lengths(x[c]).max(initial=0) for x in (have, want) for c in ("small", "large")))
        found = []
        if have.num_rows and want.num_rows:
            have = have.sort_by("id")
            x, y = (matrix(t["small"], terms) + matrix(t["large"], terms) for t in (have, want))
            ids, own, marks = have["id"].to_numpy(), want["id"].to_numpy(), want["query"].to_numpy()
            plain, small = np.abs(x).max(axis=1) < LARGEST, np.abs(y).sum(axis=1) < LARGEST_SUM
            for search, c, q in ((best_of_shard, plain, small), (best_of_wide, ~plain, small), (best_of_wide, plain | ~plain, ~small)):
                if c.any() and q.any():
                    at, which, sums = search(ids[c], x[c], own[q], y[q], k)
                    found.append((marks[q][at], own[q][at], ids[c][which], [int(v) for v in sums]))
        none = np.zeros(0, np.int64)
        mark, of, to = (np.concatenate([none, *(f[i] for f in found)]) for i in range(3))
        sums = [v for f in found for v in f[3]]
        cut = pa.array([max(-(1 << 63), min((1 << 63) - 1, v)) for v in sums], pa.int64())
        return pa.table({"query": mark, "query_id": of, "id": to, "score": cut, "beyond": pa.array([beyond(v) for v in sums], pa.binary())})

    pairs = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(score, "query long, query_id long, id long, score long, beyond binary")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.desc("beyond"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
