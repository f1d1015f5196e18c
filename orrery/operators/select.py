"""Which records are indexed, and which of them are queries."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.errors import RetrievalError
from orrery.functions import paths
from orrery.shared import ship, written

#: Missing files that an error lists, and names of a folder that are handed on together.
LISTED, LISTING = 5, 10_000


def numbered(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """df with pos, 0 to N - 1 in the order of the columns (which tell rows apart).

    Rows are sorted by ranges, and each range gets the number of rows before it: no step has all rows in one task.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    split = ranges.withColumn("part", F.shiftright("at", 33)).withColumn("nth", F.col("at").bitwiseAND((1 << 33) - 1))
    sizes = split.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(F.col("part").alias("of"), before.alias("first"))
    return split.join(F.broadcast(firsts), F.col("part") == F.col("of")).select(*df.columns, (F.col("first") + F.col("nth")).alias("pos"))


def head(records: DataFrame, max_images: int | None) -> DataFrame:
    """The first max_images records by position; null: all."""
    return records if max_images is None else records.filter(F.col("pos") < max_images)


def require_two(records: DataFrame) -> None:
    if len(records.limit(2).take(2)) < 2:
        raise RetrievalError("Retrieval needs at least two selected images: raise dataset.max_images or take a longer manifest.")


def with_paths(records: DataFrame, root: str) -> DataFrame:
    return records.withColumn("path", paths.joined(F.lit(root), F.col("file_name")))


def folders_of(records: DataFrame) -> DataFrame:
    """folder of each folder that records' files should be in, once."""
    return records.select(F.regexp_extract("path", r"(?s)\A(.*)/", 1).alias("folder")).distinct()


def files_of(records: DataFrame) -> DataFrame:
    """path of each file in the folders that records' files should be in: one listing for each folder, in the tasks.

    Folders are on this machine, or in a store whose address begins with a scheme that Arrow's file systems know.
    """
    ship(records.sparkSession)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = listing(folder)
                while some := [f"{folder}/{name}" for name in itertools.islice(found, LISTING)]:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["path"])

    return folders_of(records).mapInArrow(listed, "path string")


def listing(folder: str) -> Iterator[str]:
    """Names of the files in a folder; none if it is not there."""
    try:
        if "://" in folder:
            from pyarrow import fs

            store, place = fs.FileSystem.from_uri(folder)
            yield from (x.base_name for x in store.get_file_info(fs.FileSelector(place, allow_not_found=True)) if x.is_file)
        else:
            with os.scandir(folder or "/") as found:
                yield from (x.name for x in found if x.is_file())
    except (FileNotFoundError, NotADirectoryError):
        return


def missing(records: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Records without a file."""
    return records.join(files.select(key).distinct(), key, "left_anti")


def missing_preview(records: DataFrame, files: DataFrame, key: str = "path", listed: int = LISTED) -> DataFrame:
    """pos and key of the first missing records, and more, the number of further ones, in each row."""
    lost = missing(records, files, key).select("pos", key)
    more = lost.agg(F.greatest(F.count("*") - listed, F.lit(0))).scalar()
    return lost.orderBy("pos").limit(listed).withColumn("more", more)


def require_files(records: DataFrame, files: DataFrame) -> None:
    rows = missing_preview(records, files).orderBy("pos").collect()
    if rows:
        more = [f"... and {rows[0]['more']} more"] if rows[0]["more"] else []
        raise RetrievalError("\n  - ".join(["Selected images are missing:", *[r["path"] for r in rows], *more]))


def by_stride(records: DataFrame, stride: int) -> DataFrame:
    """query_ord and query_pos of every stride-th record."""
    return records.filter(F.col("pos") % stride == 0).select((F.col("pos") / stride).cast("long").alias("query_ord"), F.col("pos").alias("query_pos"))


def wanted(spark: SparkSession, ids: Sequence[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ids)), "query_ord long, image_id long")


def by_ids(records: DataFrame, ids: Sequence[int]) -> DataFrame:
    """query_ord and query_pos of the records of the ids, in their order; a repeated id is a query again."""
    found = records.select("image_id", F.col("pos").alias("query_pos"))
    return found.join(wanted(records.sparkSession, ids), "image_id").select("query_ord", "query_pos")


def unknown_ids(records: DataFrame, ids: Sequence[int]) -> DataFrame:
    """query_ord and image_id of those ids that no record has."""
    return wanted(records.sparkSession, ids).join(records.select("image_id"), "image_id", "left_anti").select("query_ord", "image_id")


def queries_of(records: DataFrame, ids: Sequence[int], stride: int) -> DataFrame:
    """Queries by ids if there are any, else by stride; unknown ids are an error that lists them in their order."""
    if not ids:
        return by_stride(records, stride)
    if unknown := [str(r["image_id"]) for r in unknown_ids(records, ids).orderBy("query_ord").collect()]:
        raise RetrievalError("h1.query_image_ids contains ids that no selected image has: " + ", ".join(unknown))
    return by_ids(records, ids)


def batches(records: DataFrame, size: int) -> DataFrame:
    """records with batch, the number of the run of size consecutive positions that each is in."""
    return records.withColumn("batch", F.floor(F.col("pos") / size).cast("long"))
