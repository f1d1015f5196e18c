"""Functions on array columns. Sums are of doubles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import arrays, resample

#: The least norm that vectors are divided by.
LEAST_NORM = 1e-12


def doubles(vector: Column) -> Column:
    """A vector of any numbers as doubles."""
    return vector.cast("array<double>")


def floats(vector: Column) -> Column:
    """A vector of any numbers as 32-bit floats."""
    return vector.cast("array<float>")


def dot(one: Column, two: Column) -> Column:
    """Inner product; null where a vector is, or lengths differ."""
    products = F.zip_with(doubles(one), doubles(two), lambda x, y: x * y)
    return F.when(F.size(one) == F.size(two), F.aggregate(products, F.lit(0.0), lambda a, x: a + x))


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalized(vector: Column) -> Column:
    """The vector divided by its norm, or by LEAST_NORM if that is more: a zero vector stays as it is."""
    length = F.greatest(norm(vector), F.lit(LEAST_NORM))
    return F.transform(doubles(vector), lambda x: x / length)


def of_shape(function: Callable[[np.ndarray], np.ndarray], shape: Sequence[int]) -> Callable[[Column], Column]:
    """A column function from one on arrays (rows, *shape); -1 in shape is what the values of a row leave. Null where the values are."""

    @F.pandas_udf("array<double>")
    def apply(values: pd.Series) -> pd.Series:
        there = values.notna()
        rows = [np.asarray(v, np.float64).reshape(shape) for v in values[there]]
        found = pd.Series([None] * len(values), index=values.index, dtype=object)
        found[there] = pd.Series([np.asarray(function(r[None])[0]).ravel() for r in rows], index=values[there].index, dtype=object)
        return found

    return lambda column: apply(doubles(column))


def mean_pooled(features: Column, shape: Sequence[int]) -> Column:
    """The mean over all axes of a row's values but the first; shape is that of a row."""
    return of_shape(arrays.pooled, shape)(features)


def channel_normalized(values: Column, means: Sequence[float], stds: Sequence[float]) -> Column:
    """(x - mean) / std by channel, for values laid out in equal runs, a run for each channel."""
    return of_shape(lambda x: arrays.channel_normalized(x, means, stds), (len(means), 1, -1))(values)


def resized(image: Column, shape: tuple[int, int], to: tuple[int, int], kernel: str) -> Column:
    """An image of one channel, row after row, in another size: (rows, columns) each."""
    return of_shape(lambda x: resample.resized(x, *to, kernel), shape)(image)
