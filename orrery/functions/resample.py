"""Resizing of images: separable resampling with antialias, as two matrix products.

An output place looks at the input around its own place, as far as the kernel reaches; where the image gets smaller the
kernel gets wider by as much, so that no input is passed over. The weights of one axis depend on its two sizes and the
kernel only: a table of (output size, input size), made once. Rows and columns are independent, so an image is resized
by one product with each table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np


def _box(x: float) -> float:
    return 1.0 if -0.5 < x <= 0.5 else 0.0


def _bilinear(x: float) -> float:
    return max(0.0, 1.0 - abs(x))


def _hamming(x: float) -> float:
    return _sinc(x) * (0.54 + 0.46 * math.cos(math.pi * x)) if abs(x) < 1 else 0.0


def _bicubic(x: float, a: float = -0.5) -> float:
    x = abs(x)
    if x < 1:
        return ((a + 2) * x - (a + 3)) * x * x + 1
    return ((x - 5) * x + 8) * x * a - 4 * a if x < 2 else 0.0


def _lanczos(x: float) -> float:
    return _sinc(x) * _sinc(x / 3) if -3 <= x < 3 else 0.0


def _sinc(x: float) -> float:
    return math.sin(math.pi * x) / (math.pi * x) if x else 1.0


#: Kernels by name, and how far each reaches.
KERNELS: dict[str, tuple[Callable[[float], float], float]] = {"box": (_box, 0.5), "bilinear": (_bilinear, 1.0), "hamming": (_hamming, 1.0), "bicubic": (_bicubic, 2.0), "lanczos": (_lanczos, 3.0)}
#: Names of interpolations without a kernel: the input at the middle of each output place.
NEAREST = ("nearest", "nearest_exact")


@functools.lru_cache(maxsize=64)
def weights(size: int, to: int, name: str) -> np.ndarray:
    """(to, size): what each input place adds to each output place; rows sum to one."""
    out, scale = np.zeros((to, size)), size / to
    if name in NEAREST:
        out[np.arange(to), np.minimum(((np.arange(to) + 0.5) * scale).astype(int), size - 1)] = 1.0
        return out
    kernel, reach = KERNELS[name]
    wide = max(scale, 1.0)
    for k in range(to):
        middle = (k + 0.5) * scale
        first, last = max(0, int(middle - reach * wide + 0.5)), min(size, int(middle + reach * wide + 0.5))
        row = [kernel((x + 0.5 - middle) / wide) for x in range(first, last)]
        out[k, first:last] = np.array(row) / sum(row)
    return out


def resized(images: np.ndarray, height: int, width: int, name: str) -> np.ndarray:
    """(..., height, width) of images (..., rows, columns), as doubles."""
    across = images.astype(np.float64) @ weights(images.shape[-1], width, name).T
    return weights(images.shape[-2], height, name) @ across


#: What a sum of weighted bytes may be wrong by.
ERROR = 1e-7


def to_bytes(values: np.ndarray) -> np.ndarray:
    """Values as bytes: the nearest from 0 to 255, halves up, also where a sum falls short of one by its rounding."""
    return np.clip(np.floor(values + 0.5 + ERROR), 0, 255).astype(np.uint8)
