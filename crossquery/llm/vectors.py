"""Vectors from array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors, and these as rows of doubles.

    Unusable: null, empty, zero, with a null or non-finite component, or of another length than
    ``dims`` (where given).
    """
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()]) if len(column) else np.zeros(0, np.int64)
    if dims is None:
        dims = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    if not dims:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    at = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    x = np.array(flat.fill_null(float("nan"))).reshape(len(at), dims)
    with np.errstate(over="ignore", invalid="ignore"):
        good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], np.ascontiguousarray(x[good])


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products with one vector (or row by row), in an order that other rows don't change."""
    return np.einsum("ij,j->i", x, y) if y.ndim == 1 else np.einsum("ij,ij->i", x, y)
