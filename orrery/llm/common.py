"""What the operators share: tables, the shared folder, words and word hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.shared import ship, written

__all__ = ["GAP", "KEPT_WORDS", "SPACES", "WordHashes", "carried", "mapped", "mixed", "odd_numbers", "pieces", "regrouped", "ship", "shuffle_partitions", "slices", "table", "words_of", "written"]

#: Characters between words, in every operator: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular expression.
GAP = r"[\x20\x09-\x0D]+"
#: A byte between words, and one between lines.
SPACE, LINE_END = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"\n")
#: Words whose value a Python worker keeps at most; further words are worked out each time.
KEPT_WORDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP, -1))


class WordHashes(dict):
    """64-bit hash of a word (bytes), kept for the first KEPT_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def pieces(text: bytes, size: int, ends: re.Pattern[bytes]) -> Iterator[bytes]:
    """The text in runs of about size bytes, cut at a byte that ends finds, which is left out; a text of up to size bytes is one."""
    start = 0
    while start <= len(text):
        found = ends.search(text, start + size)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end + 1


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about size bytes of a column of texts; none if it has no rows."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths + 16, dtype=np.int64) // size
    cuts = [0, *(np.nonzero(np.diff(run))[0] + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def regrouped(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut to ones of about size bytes of a column of texts; a row of more is one by itself."""
    held, now = [], 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for k, n in enumerate(lengths.tolist()):
            if now and now + n > size:
                held.append(batch.slice(start, k - start))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, now, start = [], 0, k
            now += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def carried(df: DataFrame, keep: list[str] | None, **inputs: Column) -> DataFrame:
    """row, a struct of the columns in keep (None: all), then the named inputs: what a Python function is handed."""
    ship(df.sparkSession)
    return df.select(F.struct(*(F.col(f"`{c}`") for c in keep) if keep else "*").alias("row"), *(c.alias(k) for k, c in inputs.items()))


def mapped(df: DataFrame, function, fields: str) -> DataFrame:
    """df, which has row first, through function (record batches to record batches of row and the fields)."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([StructField("row", df.schema["row"].dataType), *_parse_datatype_string(fields).fields])
    return df.mapInArrow(function, schema)
