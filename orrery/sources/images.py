"""Contents of image files as arrays: Netpbm files by this library, all others by Pillow where it is installed."""

from __future__ import annotations

import re

import numpy as np

#: Of a Netpbm file with bytes for values (P5 gray, P6 colour): its kind, width, height and largest value, with comments between them.
NETPBM = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def netpbm(content: bytes) -> np.ndarray | None:
    """(rows, columns, 3) bytes of a Netpbm file; None if it is another kind. An error if it is cut short."""
    head = NETPBM.match(content)
    if not head:
        return None
    channels, width, height, most = 3 if head[1] == b"6" else 1, int(head[2]), int(head[3]), int(head[4])
    wide = most > 255
    values = np.frombuffer(content, ">u2" if wide else np.uint8, width * height * channels, head.end()).reshape(height, width, channels)
    if not 0 < most < 65_536 or not values.size:
        raise ValueError("a Netpbm file without values")
    if most != 255:
        values = (np.minimum(values, most).astype(np.float64) * 255 / most + 0.5).astype(np.uint8)
    return np.broadcast_to(values, (height, width, 3))


def decoded(content: bytes) -> np.ndarray:
    """(rows, columns, 3) bytes of an image file."""
    found = netpbm(content)
    if found is not None:
        return found
    import io

    from PIL import Image

    with Image.open(io.BytesIO(content)) as image:
        return np.asarray(image.convert("RGB"))
