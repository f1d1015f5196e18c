"""Cached features: generations of Parquet files that never change, and numbered files that tell which one counts.

A writer puts a new generation into the folder under a name of its own and then the next number, a small file that
names it and tells what it was made from. Numbers are put in place whole and never replaced, so of two writers at once
one gets the number and the other, which sees that it is taken, the one after it; the highest number counts. Readers
take the highest number as they begin; its generation stays until two further numbers have come.
"""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.errors import RetrievalError
from orrery.operators import order
from orrery.sources import files

SCHEMA = "pos long, image_id long, file_name string, features array<float>"
ABOUT = re.compile(r"about-(\d{12})\.json")
REBUILD = "Set h1.reuse_feature_cache: false to rebuild it."
#: Numbers that are kept: the one that counts, and the one that readers may still have.
KEPT = 2


def numbers(spark: SparkSession, folder: str | Path) -> list[int]:
    return [int(found[1]) for name in files.names(spark, folder) if (found := ABOUT.fullmatch(name))]


def about_of(spark: SparkSession, folder: str | Path, number: int) -> dict[str, Any]:
    return json.loads(files.read_text(spark, f"{files.uri(folder)}/about-{number:012}.json"))


def save_cache(features: DataFrame, folder: str | Path, about: dict[str, Any]) -> DataFrame:
    """features (pos, image_id, file_name, features) as the generation that counts from now on, with about; returns them as they were written."""
    spark, top = features.sparkSession, files.uri(folder)
    generation = f"vectors-{uuid.uuid4().hex}"
    features.select("pos", "image_id", "file_name", "features").write.parquet(f"{top}/{generation}")
    text = json.dumps(about | {"generation": generation}, sort_keys=True)
    number = max(numbers(spark, top), default=0) + 1
    while not files.put_new(spark, f"{top}/about-{number:012}.json", text):
        number += 1  # another writer was first
    for old in [n for n in numbers(spark, top) if n <= number - KEPT]:
        files.delete(spark, f"{top}/{about_of(spark, top, old)['generation']}")
        files.delete(spark, f"{top}/about-{old:012}.json")
    return spark.read.schema(SCHEMA).parquet(f"{top}/{generation}")


def same_order(cached: DataFrame, records: DataFrame) -> bool:
    """Whether both have the same ids at the same positions."""
    one, two = (order.fingerprint(x.select("pos", "image_id", F.lit("").alias("file_name"))) for x in (cached, records))
    return one == two


def shape_of(cached: DataFrame) -> tuple[int, int | None, int | None]:
    """Vectors, and their least and largest length."""
    shape = cached.agg(F.count("features").alias("n"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most")).first()
    return shape["n"], shape["least"], shape["most"]


def well_shaped(cached: DataFrame, rows: int) -> bool:
    """Whether there are as many vectors as rows, of one length."""
    n, least, most = shape_of(cached)
    return n == rows and bool(most) and least == most


def load_cache(spark: SparkSession, folder: str | Path, records: DataFrame, about: dict[str, Any], signs: Any = None) -> DataFrame | None:
    """The cached features, or None if there are none; an error if they are of other records, another model or other settings.

    about: model_name and feature_config_signature as they are now. signs: order.fingerprint(records), if it is known.
    The cached rows are read once, for their order, names and shape together.
    """
    signs = signs or order.fingerprint(records)
    try:
        if not (known := numbers(spark, folder)):
            return None
        kept = about_of(spark, folder, max(known))
        cached = spark.read.schema(SCHEMA).parquet(f"{files.uri(folder)}/{kept['generation']}")
        found = cached.agg(*order.sums(), F.count("features").alias("vectors"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most")).first()
    except Exception as error:
        if isinstance(error, (OSError, ValueError, KeyError, TypeError, PySparkException)) or type(error).__name__ == "Py4JJavaError":
            raise RetrievalError(f"Feature cache can't be read: {folder}: {error}") from error
        raise
    if (found["n"], found["ids"]) != (signs["n"], signs["ids"]):
        raise RetrievalError(f"Feature cache does not match the selected images: {folder}: {order.first_difference(records, cached)}. {REBUILD}")
    if found["names"] != signs["names"]:
        raise RetrievalError(f"Feature cache has other image names: {folder}: {order.first_difference(records, cached)}. {REBUILD}")
    for key, what in (("model_name", "was made by another model"), ("feature_config_signature", "was made with another checkpoint or other settings")):
        if kept.get(key) != about[key]:
            raise RetrievalError(f"Feature cache {what}: {folder}. {REBUILD}")
    if found["vectors"] != signs["n"] or not found["most"] or found["least"] != found["most"]:
        raise RetrievalError(f"Feature cache has vectors that are missing or of different lengths: {folder}")
    return cached
