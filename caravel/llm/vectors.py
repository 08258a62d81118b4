"""Vectors in Arrow columns, whole numbers made of them, and exact products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(vector: str | Column) -> Column:
    """Whether a vector takes part: neither null nor holding a null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A column of lists as float64 rows of one width (the longest by default); shorter ones end in zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    for i, (end, n) in enumerate(zip(np.cumsum(lengths), lengths, strict=True)):
        out[i, :n] = values[end - n : end]
    return out


def reach(rows: np.ndarray) -> float:
    """The greatest length of a row, 0 without rows."""
    return float(np.sqrt(np.square(rows).sum(axis=1).max(initial=0.0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of ``a`` by rows of ``b``) of whole numbers held as floats.

    By Cauchy-Schwarz no partial sum exceeds the product of the lengths, so single precision is exact
    below 2^24 and double precision below 2^53; beyond that, Python integers.
    """
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = reach(a) * reach(b) * (1 + 1e-9)
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return whole(a) @ whole(b).T


def as_long(values: np.ndarray) -> np.ndarray:
    """int64; what doesn't fit is held at the type's limits."""
    if values.dtype != object:
        return values.astype(np.int64, copy=False)
    top = 2**63 - 1
    return np.array([max(-top, min(top, int(x))) for x in values.ravel()], dtype=np.int64).reshape(values.shape)
