"""Digests that tell whether cached features still fit what they were made from."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from orrery.sources.config import ModelConfig

#: Bytes of a checkpoint that are read at once.
CHUNK = 1 << 20
#: Records whose lines are put together in one task.
RUN = 100_000


def record_lines(records: DataFrame) -> DataFrame:
    """run and lines: what is signed, in runs of consecutive positions. records: pos, image_id, file_name."""
    line = F.concat(F.col("image_id").cast("string"), F.char(F.lit(0)), "file_name", F.char(F.lit(10)))
    by_run = records.select((F.col("pos") / RUN).cast("long").alias("run"), "pos", line.alias("line")).groupBy("run")
    return by_run.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("lines"))


def image_signature(records: DataFrame) -> str:
    """SHA-256 over the records' lines (id, U+0000, name, line feed) in order.

    SHA-256 takes its input in order: runs are put together by Spark and pass one after another, a partition of them
    in the driver at a time.
    """
    digest = hashlib.sha256()
    for row in record_lines(records).orderBy("run").toLocalIterator():
        digest.update(row["lines"].encode())
    return digest.hexdigest()


def checkpoint_sha256(path: Path) -> str:
    digest = hashlib.sha256()
    with path.open("rb") as file:
        while chunk := file.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def feature_signature(model: ModelConfig, checkpoint: str) -> str:
    """SHA-256 over all that a feature depends on besides the image, as compact JSON with sorted keys."""
    names = ("model_name", "image_size", "mean", "std", "interpolation", "global_pool", "use_amp", "amp_dtype", "normalize_features")
    about = {"checkpoint_sha256": checkpoint, **{n: getattr(model, n) for n in names}}
    return hashlib.sha256(json.dumps(about, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
