"""Perceptual hashes of grey rasters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, LOW = 32, 8
_ANGLES = np.pi / SIDE * np.outer(np.arange(LOW), np.arange(SIDE) + 0.5)
_COSINES = np.cos(_ANGLES)


def raster_hash(grey: np.ndarray) -> int:
    """64 bits of a 32 x 32 raster: which of the 8 x 8 lowest cosine frequencies are above their median; signed, as a long."""
    low = _COSINES @ grey.astype(np.float64) @ _COSINES.T
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def shrunk(pixels: np.ndarray) -> np.ndarray:
    """A raster of any size as 32 x 32 means (nearest pixels where it is smaller)."""
    for axis, n in enumerate(pixels.shape):
        edges = np.minimum(np.arange(SIDE + 1) * n // SIDE, n - 1)
        # equal edges stand for the one pixel they begin at
        pixels = pixels.take(np.arange(max(edges[-1], edges[-2] + 1)), axis)
        pixels = np.add.reduceat(pixels, edges[:-1], axis, dtype=np.int64)
        counts = np.maximum(np.diff(edges), 1)
        sizes = counts[:, None] if axis == 0 else sizes * counts
    return pixels / sizes


def perceptual_hash(pixels: Column | str, width: Column | str) -> Column:
    """SET10. Hash of a grey image: its bytes, row by row, and its width. Null for null, no pixels, or rows of unequal length."""

    def one(data: bytes | None, n: int | None) -> int | None:
        if not data or not n or n < 0 or len(data) % n:
            return None
        return raster_hash(shrunk(np.frombuffer(data, np.uint8).reshape(-1, n)))

    @F.arrow_udf(T.LongType())
    def hashes(data: pa.Array, widths: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(data), 256):
            out += map(one, data.slice(i, 256).to_pylist(), widths.slice(i, 256).to_pylist())
        return pa.array(out, pa.int64())

    c = lambda x: F.col(x) if isinstance(x, str) else x
    return hashes(c(pixels).cast("binary"), c(width).cast("int"))
