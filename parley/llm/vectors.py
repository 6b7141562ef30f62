"""Vectors as integers: the rows that take part, their components, and the bounds within which sums are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: str) -> Column:
    """The vector is there and holds no null and no non-finite component."""
    bad = F.exists(F.col(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(v).isNotNull() & ~bad


def whole(v: str, scale: float) -> Column:
    """Every component x as floor(scale * x)."""
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def extent(vectors: DataFrame, v: str, scale: float) -> tuple[int, int, int]:
    """(rows, longest vector, largest absolute integer component) of finite vectors; beyond 2^62 it reads 2^62."""
    largest = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    row = vectors.select(F.count("*").alias("n"), F.max(F.size(v)).alias("width"), F.max(largest).alias("most")).first()
    most = (row.most or 0.0) * scale
    return row.n, row.width or 0, (int(most) + 1 if most < 2.0**62 else 2**62)


def padded(v: Column, width: int) -> Column:
    """A shorter vector followed by zeros."""
    return F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(v)))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A list<int64> column whose lists all have `width` values, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)
