"""Vectors of integers made from float vectors, for the exact operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components from here on count as not finite: sums of their squares would leave the range of a long.
TOO_LARGE = float(1 << 15)


def usable(vec: str) -> Column:
    """Whether a vector is there and all its components are finite numbers below `TOO_LARGE`."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(TOO_LARGE))
    return F.coalesce(F.forall(F.col(vec).cast("array<double>"), good), F.lit(False))


def integers(df: DataFrame, vec: str, scale: int, step: int = 1) -> DataFrame:
    """The rows of `df` whose vector is usable, the vector replaced by floor(scale * x) of its components.

    Shorter vectors end with zeros, so that all are as long as the longest, rounded up to a multiple of `step`.
    """
    kept = df.filter(usable(vec)).withColumn(vec, F.transform(F.col(vec).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long")))
    least, most = kept.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    width = -(-(most or 0) // step) * step
    if least is None or least == width:
        return kept
    return kept.withColumn(vec, F.concat(vec, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vec))))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of integer vectors of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), dtype=np.int64)
