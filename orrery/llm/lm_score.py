"""Language-model scores by stupid backoff, from n-gram counts of the whole corpus.

S(w | h) = count(h w) / count(h) if count(h w) >= least, else `backoff` * S(w | h without its first word); at last
count(w) / words. A document's score is the sum of log S over its words; words at its beginning have shorter h.

Each partition's documents are packed into blocks of bounded size, one row with compressed texts for each. A block's
n-grams (64-bit hashes), each once with its number, are exploded to buckets by ranges of the hash. A bucket's table of counts is the sum over blocks by n-gram; joined back on the n-gram it gives each block
the sums that differ from the block's own numbers, so n-grams of one block alone get no answer. Each block then sums
the logarithms of its n-grams' counts per document. The most frequent n-gram is one entry in each block's list. What is
shuffled is the texts once (both steps on blocks use one exchange) and each block's distinct n-grams, as compressed
differences of ascending hashes. An answer names its n-grams by their places in the block's ascending list, with the
list's checksum: should a partition that is read again hold other documents, that is an error.

Cases: null and empty texts have no words, the score 0 and no mean. Texts of one word have only the unigram's score.
Repeated rows count and are scored as often as they occur. Null ids and further columns of any name pass through in
row; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from .common import WordHashes, carried, mixed, odd_numbers, regrouped, shuffle_partitions

#: Words of the longest n-gram, the factor of each backoff, and the number from which an n-gram of two or more words counts.
ORDER, BACKOFF, LEAST = 3, 0.4, 2
#: Bytes of text in a block, about.
BLOCK = 12 << 20
#: Stands for all words; its number is the corpus's.
ALL = np.uint64(1)


def codec() -> pa.Codec:
    """Compresses a block's texts."""
    return pa.Codec("zstd", compression_level=3)


def n_grams(texts: list[bytes | None], order: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of each text, each word's place in its text, and the hashes of the n-grams of 1 to order words that end at each word."""
    parts = [np.fromiter(map(known.__getitem__, (t or b"").split()), dtype=np.uint64) for t in texts]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    codes = np.concatenate([np.zeros(0, np.uint64), *parts])
    del parts
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = []
    for n in range(1, order + 1):
        sums = np.zeros(len(codes), np.uint64)
        for k, w in enumerate(odd_numbers(100 + n, n)):
            sums[k:] += codes[: len(codes) - k] * w
        out.append(mixed(sums + np.uint64(n)))
    return lengths, place, out


def listed(place: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A block's distinct n-grams, ALL and then ascending; their numbers; and for each n the place in that list of the n-gram ending at each word."""
    whole = [np.nonzero(place >= n)[0] for n in range(len(grams))]
    keys, which, counts = np.unique(np.concatenate([g[w] for g, w in zip(grams, whole, strict=True)]), return_inverse=True, return_counts=True)
    places, start = [], 0
    for w in whole:
        at = np.zeros(len(place), np.int32)
        at[w] = which[start : start + len(w)] + 1
        places.append(at)
        start += len(w)
    return np.concatenate([[ALL], keys]), np.concatenate([[len(place)], counts]), places


def checksum(keys: np.ndarray) -> int:
    return int(mixed(keys).sum(dtype=np.uint64).view(np.int64))


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: equal ranges, so ascending hashes have ascending buckets."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def squeezed(x: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then the next ones and so on, compressed after their size."""
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    raw = pa.decompress(data[4:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def scored(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST) -> DataFrame:
    """row, n_words, log_score (sum of natural logarithms) and mean_score (a word's) of every document."""
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    rows = carried(docs, keep, text=F.col(text_col).cast("binary"))
    kind = rows.schema["row"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        for nth, batch in enumerate(regrouped(batches, 1, BLOCK)):
            texts = batch.column(1)
            raw = b"".join(t or b"" for t in texts.to_pylist())
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64()).to_numpy()
            name = xxhash.xxh3_64_intdigest(raw, place << 32 | nth) & (1 << 63) - 1
            packed = len(raw).to_bytes(8, "little") + codec().compress(raw, asbytes=True)
            row = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([lengths]), pa.array([packed], pa.binary()), row], names=["block", "lengths", "texts", "rows"])

    fields = [StructField("block", LongType()), StructField("lengths", ArrayType(LongType())), StructField("texts", BinaryType()), StructField("rows", ArrayType(kind))]
    blocks = rows.mapInArrow(pack, StructType(fields))

    def unpacked(group: pa.Table) -> list[bytes]:
        out = []
        for lengths, data in zip(group["lengths"].to_pylist(), group["texts"].to_pylist(), strict=True):
            size, at = int.from_bytes(data[:8], "little"), 0
            raw = codec().decompress(data[8:], decompressed_size=size, asbytes=True) if size else b""
            for n in lengths:
                out.append(raw[at : at + n])
                at += n
        return out

    def ask(group: pa.Table) -> pa.Table:
        _, place, grams = n_grams(unpacked(group), order, WordHashes())
        keys, counts, _ = listed(place, grams)
        bucket = buckets_of(keys, buckets)
        cuts = [0, *(np.nonzero(np.diff(bucket))[0] + 1).tolist(), len(keys)]
        parts = [slice(a, z) for a, z in zip(cuts, cuts[1:], strict=False)]
        return pa.table({
            "block": pa.array([group["block"][0].as_py()] * len(parts), pa.int64()), "bucket": pa.array([int(bucket[p.start]) for p in parts], pa.int32()), "first": pa.array([p.start for p in parts], pa.int64()), "check": pa.array([checksum(keys)] * len(parts), pa.int64()),
            "keys": pa.array([squeezed(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], pa.binary()), "counts": pa.array([squeezed(counts[p]) for p in parts], pa.binary()),
        })

    def add(group: pa.Table) -> pa.Table:
        lists = [np.cumsum(unsqueezed(x, np.uint64), dtype=np.uint64) for x in group["keys"].to_pylist()]
        counts = np.concatenate([unsqueezed(x, np.int64) for x in group["counts"].to_pylist()])
        keys, which = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, which, counts)
        at, sums, start = [], [], 0
        for x in lists:
            mine = totals[which[start : start + len(x)]]
            more = np.nonzero(mine != counts[start : start + len(x)])[0]
            at.append(squeezed(np.diff(more, prepend=0)))
            sums.append(squeezed(mine[more]))
            start += len(x)
        return pa.table({"block": group["block"], "first": group["first"], "check": group["check"], "at": pa.array(at, pa.binary()), "totals": pa.array(sums, pa.binary())})

    asked = blocks.groupBy("block").applyInArrow(ask, "block long, bucket int, first long, check long, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(add, "block long, first long, check long, at binary, totals binary")

    def total(group: pa.Table, answer: pa.Table) -> pa.Table:
        lengths, place, grams = n_grams(unpacked(group), order, WordHashes())
        keys, counts, at_list = listed(place, grams)
        del grams
        if set(answer["check"].to_pylist()) != {checksum(keys)}:
            raise RuntimeError("a partition's documents changed between two reads of the input")
        for first, at, totals in zip(*(answer[c].to_pylist() for c in ("first", "at", "totals")), strict=True):
            counts[first + np.cumsum(unsqueezed(at, np.int64))] = unsqueezed(totals, np.int64)
        logs = np.log(np.maximum(counts, 1))
        out, penalty, open_ = np.zeros(len(place)), np.zeros(len(place)), np.ones(len(place), bool)
        for n in range(order, 1, -1):
            able = np.nonzero(open_ & (place >= n - 1))[0]
            whole = at_list[n - 1][able]
            enough = counts[whole] >= least
            at = able[enough]
            out[at] = logs[whole[enough]] - logs[at_list[n - 2][at - 1]] + penalty[at]
            open_[at] = False
            penalty[able[~enough]] += np.log(backoff)
        at = np.nonzero(open_)[0]
        out[at] = logs[at_list[0][at]] - logs[0] + penalty[at]
        sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), out, minlength=len(lengths)).astype(float)
        means = pa.array(sums / np.maximum(lengths, 1), mask=lengths == 0)
        return pa.table({"row": group["rows"].combine_chunks().flatten(), "n_words": pa.array(lengths), "log_score": pa.array(sums), "mean_score": means})

    schema = StructType([StructField("row", kind), StructField("n_words", LongType()), StructField("log_score", DoubleType()), StructField("mean_score", DoubleType())])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, schema)
