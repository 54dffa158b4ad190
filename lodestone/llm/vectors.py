"""Vectors as matrices of integers on a grid, as the vector operators read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grid values lie within this bound, so squares and sums of them stay exact in 64 bits; what a
#: larger component becomes is the bound.
BOUND = 1 << 27


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def on_grid(vectors: pa.Array, scale: int, dim: int | None = None) -> np.ndarray:
    """A row of floor(scale * x) for each vector of doubles; shorter ones are filled with zeros up to
    ``dim``, the longest of these by default."""
    sizes = np.diff(vectors.offsets.to_numpy())
    dim = int(sizes.max(initial=0)) if dim is None else dim
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(scale))
    flat = np.clip(flat, -BOUND, BOUND).astype(np.int64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out
