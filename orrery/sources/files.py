"""Files of any file system that Spark knows, from the driver: small ones whole, large ones put together from parts.

A path without a scheme is a local one.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def uri(path: str | Path) -> str:
    text = str(path)
    return text if "://" in text or text.startswith("file:") else f"file://{os.path.abspath(text)}"


def local(path: str | Path) -> str | None:
    """The path on this machine, of one that is local."""
    return uri(path).removeprefix("file:").replace("//", "", 1) if uri(path).startswith("file:") else None


def _opened(spark: SparkSession, path: str | Path) -> tuple[Any, Any]:
    """(file system, path) in Spark's JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(uri(path))
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.setWriteChecksum(False)  # else a local file gets another beside it, which a replaced file would not fit
    return system, at


def exists(spark: SparkSession, path: str | Path) -> bool:
    system, at = _opened(spark, path)
    return system.exists(at)


def make_folder(spark: SparkSession, path: str | Path) -> None:
    system, at = _opened(spark, path)
    system.mkdirs(at)


def delete(spark: SparkSession, path: str | Path) -> None:
    system, at = _opened(spark, path)
    system.delete(at, True)


def names(spark: SparkSession, folder: str | Path) -> list[str]:
    """Sorted names of what is in a folder; none if there is no such folder."""
    system, at = _opened(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def read_text(spark: SparkSession, path: str | Path) -> str:
    system, at = _opened(spark, path)
    stream = system.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace(spark: SparkSession, beside: str, path: str | Path) -> None:
    """Puts a file in place of path, whether or not there is one, in one step."""
    if here := local(path):
        os.replace(local(beside), here)
        return
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(uri(p)) for p in (beside, path))
    kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, how)


def put_new(spark: SparkSession, path: str | Path, text: str) -> bool:
    """A new file, seen only with all of its text; False if there is one of this name."""
    beside = write_beside(spark, path, [text.encode()])
    try:
        if here := local(path):
            try:
                os.link(local(beside), here)
            except FileExistsError:
                return False
            return True
        if exists(spark, path):
            return False
        source, target = (spark._jvm.org.apache.hadoop.fs.Path(uri(p)) for p in (beside, path))
        how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, how)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True
    finally:
        delete(spark, beside)


def write_beside(spark: SparkSession, path: str | Path, pieces: list[bytes]) -> str:
    """The path of a file with these bytes, of a name of its own in the folder of path."""
    beside = f"{uri(path)}.{uuid.uuid4().hex}.tmp"
    system, at = _opened(spark, beside)
    out = system.create(at, True)
    try:
        for piece in pieces:
            out.write(piece)
    finally:
        out.close()
    return beside


def write_text(spark: SparkSession, path: str | Path, text: str) -> None:
    """path with this text, in place of what was there once all of it is written."""
    beside = write_beside(spark, path, [text.encode()])
    try:
        replace(spark, beside, path)
    except (PySparkException, OSError):
        delete(spark, beside)
        raise


def write_json(spark: SparkSession, path: str | Path, value: Any) -> None:
    """value as JSON with sorted keys, two spaces deep, and a line feed at its end."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True) + "\n")


def write_joined(spark: SparkSession, path: str | Path, before: str, folder: str, between: str, end: str, after: str) -> None:
    """path with before, the files that Spark wrote to a folder in the order of their names, and after.

    Each file ends with `between` if it is not empty; in place of the last such end comes `end`. Bytes are copied from
    stream to stream in Spark's JVM, no rows are read.
    """
    system, at = _opened(spark, folder)
    number = lambda s: int(s.getPath().getName().split("-")[1])
    parts = sorted((s for s in system.listStatus(at) if s.getPath().getName().startswith("part-") and s.getLen()), key=number)
    beside = f"{uri(path)}.{uuid.uuid4().hex}.tmp"
    target, place = _opened(spark, beside)
    out = target.create(place, True)
    try:
        out.write(before.encode())
        for k, part in enumerate(parts):
            stream = system.open(part.getPath())
            try:
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, part.getLen() - (len(between.encode()) if k == len(parts) - 1 else 0))
            finally:
                stream.close()
        out.write(((end if parts else "") + after).encode())
        out.close()
        replace(spark, beside, path)
    except BaseException:
        out.close()
        delete(spark, beside)
        raise
