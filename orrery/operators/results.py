"""From ranked matches to results, and their file."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.shared import shared_folder, ship
from orrery.sources import files


def named(matches: DataFrame, records: DataFrame) -> DataFrame:
    """Flat results: query_ord, query_id, query_file_name, rank, image_id, file_name, cosine_similarity."""
    of_query = records.select(F.col("pos").alias("query_pos"), F.col("image_id").alias("query_id"), F.col("file_name").alias("query_file_name"))
    out = matches.join(records.select("pos", "image_id", "file_name"), "pos").join(of_query, "query_pos")
    return out.select("query_ord", "query_id", "query_file_name", "rank", "image_id", "file_name", F.col("score").alias("cosine_similarity"))


def nested(flat: DataFrame) -> DataFrame:
    """A row for each query: query_ord, image_id, file_name and its matches by rank (k of them at most)."""
    match = F.struct("rank", "image_id", "file_name", "cosine_similarity")
    by_query = flat.groupBy("query_ord", "query_id", "query_file_name").agg(F.array_sort(F.collect_list(match)).alias("matches"))
    return by_query.select("query_ord", F.col("query_id").alias("image_id"), F.col("query_file_name").alias("file_name"), "matches")


def write_listed(path: str | Path, header: dict[str, Any], key: str, rows: DataFrame, order: str) -> None:
    """One JSON document of header and, as a list at key, the rows by the column order (which is left out), as files.write_json() would write it.

    Tasks write their rows as text, in ranges of the order; Spark commits one attempt of each. Only then are these files
    put together and take the place of path, so a run that fails leaves what was there, and no row is read by the driver.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    ship(spark)
    text = json.dumps(header | {key: []}, indent=2, sort_keys=True)
    before, _, after = text.partition(f'{json.dumps(key)}: []')

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f"\n{json.dumps(row, indent=2, sort_keys=True)}".replace("\n", "\n    ") for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    try:
        rows.orderBy(order).drop(order).mapInArrow(lines, "value string").write.option("lineSep", ",").text(folder)
        files.write_joined(spark, path, f"{before}{json.dumps(key)}: [", folder, ",", "\n  ", f"]{after}\n")
    finally:
        files.delete(spark, folder)


def write_results(path: str | Path, header: dict[str, Any], queries: DataFrame) -> None:
    """header and `queries` (rows of nested()) as one JSON document."""
    write_listed(path, header, "queries", queries, "query_ord")
