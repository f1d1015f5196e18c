"""Manifests: a JSON object whose list `images` names records by id and file_name.

A manifest may be of any size: all tasks read it, in blocks (see sources.blocks), and no value holds more than one
element of its list. Each element is then judged by itself as VARIANT, which keeps the kinds of values apart, so 1.0,
true and "1" are no ids. One CASE column names the first rule that a record breaks, and the error of the record that
comes first is raised. JSON-lines files, an element in each line, are split by Spark itself.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from orrery.errors import ManifestError
from orrery.functions import paths
from orrery.shared import written
from orrery.sources.blocks import BLOCK, elements

#: Of a record: its place in the list, id and name.
RECORDS = "pos long, image_id long, file_name string"
#: How names of JSON-lines files end.
LINES = (".jsonl", ".ndjson")


def kind(column: str) -> Column:
    return F.schema_of_variant(column)


def raw_records(spark: SparkSession, manifest: str, block: int = BLOCK) -> DataFrame:
    """pos and item (variant) of each element of `images`; all tasks read, blocks of the file each."""
    try:
        files = spark.read.format("binaryFile").load(manifest).select("length").take(2)
        if len(files) != 1:
            raise ManifestError(f"Manifest must be one file: {manifest}")
        found = elements(spark, manifest, files[0]["length"], block)
    except PySparkException as error:
        raise ManifestError(f"Manifest can't be read: {manifest}: {error}") from error
    except ManifestError as error:
        raise ManifestError(f"{error}: {manifest}") from error
    return parsed(found)


def read_records(spark: SparkSession, lines: str) -> DataFrame:
    """pos and item (variant) of JSON-lines files, an element of a manifest's list in each line; Spark splits them."""
    from orrery.operators.select import numbered

    text = spark.read.text(lines).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("nth"))
    return parsed(numbered(text.filter("trim(value) <> ''"), "file", "nth").select("pos", F.col("value").alias("item")))


def parsed(parts: DataFrame) -> DataFrame:
    """pos and item as VARIANT; one that is no JSON is null, as no object."""
    return parts.select("pos", F.try_parse_json("item").alias("item"))


def kind_of(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def judged(items: DataFrame) -> DataFrame:
    """pos, image_id, file_name and violation (null: none) of raw_records()."""
    parts = items.select(
        F.col("pos").cast("long").alias("pos"),
        F.coalesce(kind("item"), F.lit("VOID")).alias("item_kind"),
        kind_of(F.try_variant_get("item", "$.id", "variant")).alias("id_kind"),
        kind_of(F.try_variant_get("item", "$.file_name", "variant")).alias("name_kind"),
        F.try_variant_get("item", "$.id", "bigint").alias("image_id"),
        F.try_variant_get("item", "$.file_name", "string").alias("file_name"),
    )
    is_id = F.col("id_kind") == "BIGINT"
    nth = F.row_number().over(Window.partitionBy(F.when(is_id, F.col("image_id")), F.when(is_id, F.lit(0)).otherwise(F.col("pos"))).orderBy("pos"))
    where = F.concat(F.lit("images["), F.col("pos").cast("string"), F.lit("]"))
    violation = (
        F.when(~F.col("item_kind").startswith("OBJECT"), F.concat(where, F.lit(" must be an object.")))
        .when(~is_id, F.concat(where, F.lit(".id must be an integer of at most 64 bits.")))
        .when(F.col("nth") > 1, F.concat(F.lit("Duplicate image id in manifest: "), F.col("image_id").cast("string")))
        .when((F.col("name_kind") != "STRING") | paths.is_blank(F.col("file_name")), F.concat(where, F.lit(".file_name must be a non-empty string.")))
        .when(paths.is_unsafe(F.col("file_name")), F.concat(where, F.lit(".file_name must be relative to dataset.root: "), F.col("file_name")))
    )
    return parts.withColumn("nth", nth).select("pos", "image_id", "file_name", violation.alias("violation"))


def checked(spark: SparkSession, manifest: str, root: str | None = None) -> tuple[DataFrame, int]:
    """pos, image_id, file_name (and with a root, path) of the records, all of them valid, and their number.

    A name that ends as LINES say is of a JSON-lines file. The records are written once, and what is asked of them (their
    number, the first violation) is observed in the tasks that write them: no further pass reads them.
    """
    records = judged(read_records(spark, manifest) if manifest.lower().endswith(LINES) else raw_records(spark, manifest))
    if root is not None:
        records = records.withColumn("path", paths.joined(F.lit(root), F.col("file_name")))
    seen = Observation()
    kept = written(records.observe(seen, F.count("*").alias("n"), F.min_by("violation", F.when(F.col("violation").isNotNull(), F.col("pos"))).alias("first")))
    if seen.get["first"]:
        raise ManifestError(seen.get["first"])
    if not seen.get["n"]:
        raise ManifestError(f"Manifest contains no image records: {manifest}")
    return kept.drop("violation"), seen.get["n"]


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    return checked(spark, manifest)[0]
