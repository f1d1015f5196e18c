"""Features of images: pluggable embedders, applied to batches of tensors in the executors' Python workers.

A task reads and prepares its own images, and Spark's batch prediction stacks them to tensors of at most batch_size
rows. An embedder makes its net once in each worker; the net turns a batch into an array of a row for each image, of any
number of axes, and those after the second are averaged. Here are `timm` models (where that library is installed), a
small convolutional net whose weights are in its checkpoint, and a stand-in that is made of the files' bytes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from orrery.errors import RetrievalError
from orrery.functions import arrays, resample, vectors
from orrery.operators import select
from orrery.shared import ship
from orrery.sources import images
from orrery.sources.config import ModelConfig

#: Names of interpolations.
INTERPOLATIONS = ("nearest", "nearest_exact", "bilinear", "bicubic", "box", "hamming", "lanczos")
#: Images that are handed on together; each may be some hundred kilobytes.
ROWS = 32

Net = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Embedder:
    """shape: of a prepared image; prepare: from a file's content to its values; make: the net, from batches of prepared images to features."""

    shape: tuple[int, ...]
    prepare: Callable[[bytes], np.ndarray]
    make: Callable[[], Net]


def interpolation(name: str) -> str:
    if name.lower() not in INTERPOLATIONS:
        raise RetrievalError(f"Unsupported interpolation '{name}'; choose one of: {', '.join(INTERPOLATIONS)}.")
    return name.lower()


def pixels(content: bytes, model: ModelConfig) -> np.ndarray:
    """(channels, height, width) of an image: resized to the model's size, from 0 to 1, and normalized by channel."""
    channels = images.decoded(content).transpose(2, 0, 1)
    sized = resample.to_bytes(resample.resized(channels, *model.image_size, interpolation(model.interpolation)))
    return arrays.channel_normalized(sized / 255.0, model.mean, model.std)


def timm_embedder(model: ModelConfig) -> Embedder:
    def make() -> Net:
        import timm
        import torch

        net = timm.create_model(model.model_name, pretrained=True, pretrained_cfg_overlay={"file": str(model.checkpoint)}, num_classes=0, global_pool=model.global_pool).eval()

        def run(batch: np.ndarray) -> np.ndarray:
            with torch.inference_mode():
                return net(torch.from_numpy(batch)).float().numpy()

        return run

    return Embedder((3, *model.image_size), lambda content: pixels(content, model), make)


def convolved(image: np.ndarray, kernels: np.ndarray, bias: np.ndarray, stride: int = 2) -> np.ndarray:
    """(kernels, height, width) of an image (channels, height, width) by kernels (n, channels, rows, columns), with zeros around; negative values become 0."""
    _, channels, rows, columns = kernels.shape
    padded = np.pad(image, ((0, 0), (rows // 2, rows // 2), (columns // 2, columns // 2)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, (rows, columns), axis=(1, 2))[:, ::stride, ::stride]
    height, width = windows.shape[1:3]
    flat = windows.transpose(0, 3, 4, 1, 2).reshape(channels * rows * columns, height * width)
    return np.maximum(kernels.reshape(len(kernels), -1) @ flat + bias[:, None], 0).reshape(len(kernels), height, width)


def save_small_net(path: Path, widths: tuple[int, ...] = (16, 32), seed: int = 0) -> None:
    """A checkpoint of a small net: a layer of 3 by 3 kernels for each width, of fixed weights for a seed."""
    rng, before, layers = np.random.default_rng(seed), 3, {}
    for k, n in enumerate(widths):
        layers[f"kernels{k}"] = rng.normal(0, (2 / (9 * before)) ** 0.5, (n, before, 3, 3)).astype(np.float32)
        layers[f"bias{k}"], before = rng.normal(0, 0.1, n).astype(np.float32), n
    with path.open("wb") as file:
        np.savez(file, **layers)


def small_embedder(model: ModelConfig) -> Embedder:
    """A net as save_small_net() writes it. Each image goes through it by itself, so features don't depend on the batches."""

    def make() -> Net:
        with np.load(model.checkpoint, allow_pickle=False) as file:
            layers = [(file[f"kernels{k}"].astype(np.float64), file[f"bias{k}"].astype(np.float64)) for k in range(len(file.files) // 2)]

        def run(batch: np.ndarray) -> np.ndarray:
            out = []
            for image in batch.astype(np.float64):
                for kernels, bias in layers:
                    image = convolved(image, kernels, bias)
                out.append(image)
            return np.stack(out)

        return run

    return Embedder((3, *model.image_size), lambda content: pixels(content, model), make)


def stand_in_embedder(model: ModelConfig) -> Embedder:
    """Features of the bytes alone: equal files have equal ones."""

    def prepare(content: bytes) -> np.ndarray:
        digest = hashlib.sha512(model.model_name.encode() + b"\0" + content).digest()
        return (np.frombuffer(digest, np.uint8).astype(np.float32) - 127.5) / 127.5

    return Embedder((64,), prepare, lambda: lambda batch: batch)


def embedder_for(model: ModelConfig) -> Embedder:
    kinds = {"stand-in": stand_in_embedder, "small-net": small_embedder}
    return next((make for name, make in kinds.items() if model.model_name.startswith(name)), timm_embedder)(model)


def prepared(records: DataFrame, embedder: Embedder, batch_size: int) -> DataFrame:
    """pos, image_id, file_name and pixels (the prepared image's values) of records, which have path.

    Each batch of consecutive positions is one task's, whatever the partitions were before. Their number is given, as
    Spark would else join partitions for the few bytes that paths have.
    """
    spark = records.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = select.batches(records.select("pos", "image_id", "file_name", "path"), batch_size).repartition(parts, "batch").sortWithinPartitions("pos")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch, values = whole.slice(start, ROWS), []
                for path in batch.column("path").to_pylist():
                    try:
                        values.append(np.asarray(embedder.prepare(Path(path).read_bytes()), np.float32).ravel())
                    except Exception as error:
                        raise RetrievalError(f"Image can't be read: {path}: {error}") from error
                columns = [batch.column(c) for c in ("pos", "image_id", "file_name")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.list_(pa.float32()))], names=["pos", "image_id", "file_name", "pixels"])

    return dealt.mapInArrow(read, "pos long, image_id long, file_name string, pixels array<float>")


def predicted(column: str, embedder: Embedder, batch_size: int) -> Column:
    """Features of prepared images, in batches; of more than two axes, those after the second are averaged."""

    def make_predict() -> Net:
        net = embedder.make()
        return lambda batch: arrays.pooled(np.asarray(net(batch))).astype(np.float32)

    return predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[list(embedder.shape)])(column)


def embedded(records: DataFrame, model: ModelConfig, embedder: Embedder | None = None) -> DataFrame:
    """pos, image_id, file_name and features of records, which have path (on a file system that executors share)."""
    ship(records.sparkSession)
    interpolation(model.interpolation)
    chosen = embedder or embedder_for(model)
    found = prepared(records, chosen, model.batch_size).select("pos", "image_id", "file_name", predicted("pixels", chosen, model.batch_size).alias("features"))
    if model.normalize_features:
        found = found.withColumn("features", vectors.floats(vectors.l2_normalized(F.col("features"))))
    return found
