"""Embeddings as rows of whole numbers, as vector codes and hard negatives read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: whole numbers reach this far from zero, over this many components at most; beyond it the sums of squares could leave 64 bits
REACH, WIDEST = 1 << 23, 1 << 10


def finite(vector: str) -> Column:
    """True where the vector is there and all its components are finite numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & sound, F.lit(False))


def whole(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component x; an error beyond REACH or WIDEST."""
    part = lambda x: F.floor(x.cast("double") * scale)
    wide = F.raise_error(F.lit(f"vectors of over {WIDEST} components, or components of over {REACH // scale}, are refused"))
    fits = (F.size(vector) <= WIDEST) & F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < REACH)
    return F.when(fits, F.transform(vector, lambda x: part(x).cast("int"))).otherwise(wide)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a batch as rows of width whole numbers; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def width_of(rows: DataFrame, vector: str) -> int:
    """The most components of any row."""
    return rows.agg(F.max(F.size(vector)).alias("n")).first().n or 0
