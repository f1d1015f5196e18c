"""Exact search: the k best rows for each query, by inner product.

Queries are dealt to columns and rows to bands of a grid, a task for each cell. A task keeps its column's queries, of a
bounded number of bytes, with the best rows so far, and streams its band's rows past them, some thousand at a time, as
matrix products. Rows are copied once for each column and queries once for each band: columns are no more than the
memory for queries asks for, and bands no more than the cluster has tasks for, so a shuffle moves
rows * columns + queries * bands vectors. Of each cell the k best go on to be ranked.

Order: score falling (NaN before all, as in Spark's own order), then position. Products of matrices only choose: pairs
that can't be left out within their rounding are summed again in a fixed order, so equal vectors have equal scores,
wherever they are. A query's own position is no match of it; other records that equal it are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.errors import RetrievalError
from orrery.functions import vectors
from orrery.shared import ship

#: Rows of a band at least, and bytes of queries that a task keeps.
SHARD, RESIDENT = 8192, 1 << 26
#: Rows of one matrix product, which has an eighth as many queries, and bytes of the vectors of pairs that are summed again at once.
STEP, PAIR_BYTES = 2048, 1 << 22
#: Queries whose scores against all rows may be asked for.
PAIRED = 64


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class Best:
    """The k best rows of each of n queries so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.room = self.size = 0

    def add(self, query: np.ndarray, pos: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, pos, score))
        self.size += len(query)
        if self.size > 2 * self.room + (1 << 16):
            self.ranked()

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, pos, score) of these rows, and all others are dropped."""
        query, pos, score = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        nan = np.isnan(score)
        order = np.lexsort((pos, -np.where(nan, np.inf, score), ~nan, query))
        query, pos, score = query[order], pos[order], score[order]
        first = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - first
        last = rank == self.k - 1
        self.least[query[last]] = np.where(np.isnan(score[last]), np.inf, score[last])
        kept = rank < self.k
        self.held = [(query[kept], pos[kept], score[kept])]
        self.room = self.size = int(kept.sum())
        return self.held[0]


def compare(best: Best, asked: np.ndarray, own: np.ndarray, rows: np.ndarray, pos: np.ndarray) -> None:
    """Adds to best what of these rows may be among the k best of the queries asked."""
    with np.errstate(invalid="ignore", over="ignore"):
        reach = 4 * rows.shape[1] * np.finfo(float).eps * np.sqrt((rows * rows).sum(axis=1).max(initial=0))
        step, pairs = max(1, STEP // 8), max(1, PAIR_BYTES // (8 * max(1, rows.shape[1])))
        for start in range(0, len(asked), step):
            some = asked[start : start + step]
            slack = reach * np.sqrt((some * some).sum(axis=1))
            able = ~(some @ rows.T < (best.least[start : start + step] - slack)[:, None])  # NaN stays
            query, row = np.nonzero(able)
            other = own[start + query] != pos[row]
            query, row = query[other], row[other]
            for at in range(0, len(query), pairs):
                q, r = query[at : at + pairs], row[at : at + pairs]
                best.add(start + q, pos[r], (some[q] * rows[r]).sum(axis=1))


def scored_pairs(features: DataFrame, queries: DataFrame) -> DataFrame:
    """query_ord, query_pos, pos and score of every row against every query but itself: a result of as many rows.

    As expressions, with sums in the order of the elements, for PAIRED queries at most, which are broadcast; top_k() is
    the way to rank many.
    """
    if queries.limit(PAIRED + 1).count() > PAIRED:
        raise RetrievalError(f"All scores are given for {PAIRED} queries at most; top_k() ranks any number.")
    asked = queries.join(features.select(F.col("pos").alias("query_pos"), F.col("features").alias("asked")), "query_pos")
    pairs = features.select("pos", "features").join(F.broadcast(asked), F.col("pos") != F.col("query_pos"))
    return pairs.select("query_ord", "query_pos", "pos", vectors.dot(F.col("features"), F.col("asked")).alias("score"))


def top_k(features: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, resident: int | None = None) -> DataFrame:
    """query_ord, query_pos, rank, pos and score. features: pos and features, all of one length; queries: query_ord and query_pos.

    shard: rows of a band at least; resident: queries of a column at most (None: as many as RESIDENT bytes hold).
    """
    spark = features.sparkSession
    ship(spark)
    about = features.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("size")).first()
    rows, asked = about["n"], queries.count()
    k = min(k, rows - 1)  # one row less than there are: a query's own never counts
    held = resident or max(1, RESIDENT // (8 * (about["size"] or 1) + 64 * max(1, k)))
    columns = -(-asked // held) or 1
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bands = max(1, min(-(-tasks // columns), -(-rows // shard)))

    def cells(band: object, column: object) -> object:
        return (band * columns + column).cast("int").alias("cell")

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    have = features.select((F.col("pos") % bands).alias("band"), each(columns).alias("column"), "pos", "features")
    have = have.select(cells(F.col("band"), F.col("column")), F.lit(True).alias("is_row"), F.lit(None).cast("long").alias("query_ord"), "pos", "features")
    want = queries.join(features.select(F.col("pos").alias("query_pos"), "features"), "query_pos")
    want = want.select(each(bands).alias("band"), (F.col("query_ord") % columns).alias("column"), "query_ord", F.col("query_pos").alias("pos"), "features")
    want = want.select(cells(F.col("band"), F.col("column")), F.lit(False).alias("is_row"), "query_ord", "pos", "features")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, own, asked, best = [], [], [], None
        for batch in batches:
            is_row = batch.column("is_row").to_numpy(zero_copy_only=False)
            split = int(np.count_nonzero(~is_row))  # queries come first
            if split:
                part = batch.slice(0, split)
                nth.append(part.column("query_ord").to_numpy())
                own.append(part.column("pos").to_numpy())
                asked.append(matrix(part.column("features")))
            if split < batch.num_rows and nth and k >= 1:
                if best is None:
                    nth, own, asked = [np.concatenate(nth)], [np.concatenate(own)], [np.concatenate(asked)]
                    best = Best(len(nth[0]), k)
                for start in range(split, batch.num_rows, STEP):
                    part = batch.slice(start, STEP)
                    compare(best, asked[0], own[0], matrix(part.column("features")), part.column("pos").to_numpy())
        if best is not None:
            query, pos, score = best.ranked()
            yield pa.RecordBatch.from_arrays([pa.array(nth[0][query]), pa.array(own[0][query]), pa.array(pos), pa.array(score, pa.float64(), from_pandas=False)], names=["query_ord", "query_pos", "pos", "score"])

    dealt = have.union(want).repartitionById(bands * columns, F.col("cell")).sortWithinPartitions("is_row")
    near = dealt.mapInArrow(search, "query_ord long, query_pos long, pos long, score double")
    order = Window.partitionBy("query_ord").orderBy(F.desc("score"), "pos")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_ord", "query_pos", "rank", "pos", "score")
