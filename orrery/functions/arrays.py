"""Functions on arrays of numpy: the one form of pooling and channel normalization, for runs and for columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from orrery.errors import RetrievalError


def pooled(features: np.ndarray) -> np.ndarray:
    """Two axes, as doubles: of more, all after the second are averaged. (n, channels, height, width) gives (n, channels), (n, tokens, width) gives (n, tokens)."""
    if features.ndim > 2:
        features = features.reshape(*features.shape[:2], -1).mean(axis=2, dtype=np.float64)
    if features.ndim != 2:
        raise RetrievalError(f"Expected features of two axes, not of shape {features.shape}.")
    return features.astype(np.float64)


def channel_normalized(images: np.ndarray, means: Sequence[float], stds: Sequence[float]) -> np.ndarray:
    """(x - mean) / std by channel, the third axis from the end."""
    one, two = (np.asarray(x, np.float64)[:, None, None] for x in (means, stds))
    return (images - one) / two
