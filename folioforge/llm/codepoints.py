"""Arrow text as numpy arrays of code points, and back, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def decode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (nulls as empty) in one uint32 array, and the offsets of each text's among them."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if len(raw) == 0:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, offsets
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, before[offsets]


def encode(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of decode()."""
    width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
    ends = np.concatenate([[0], np.cumsum(width)])[offsets]
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
