"""What driver and executors share: this package, and tables in a folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once in an application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{here.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, file.relative_to(here.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def top_folder(spark: SparkSession) -> str:
    """This application's part of spark.checkpoint.dir, which driver and executors share.

    Where the session has none, /tmp/checkpoints serves if all runs on one machine (as in tests); else that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return f"{top or 'file:///tmp/checkpoints'}/orrery/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder among those."""
    return f"{top_folder(spark)}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application wrote; results that still depend on them can't be computed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(top_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts the lineage, and lost executors cost nothing of it."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    ship(spark)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
