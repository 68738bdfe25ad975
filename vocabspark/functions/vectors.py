"""Row-local vector expressions on ARRAY columns (JVM side, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

F32_EPS = 2.0**-23


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def vec_sum(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sum_squares(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x)


def norm(vec: Column) -> Column:
    return F.sqrt(sum_squares(vec))


def normalise(vec: Column) -> Column:
    """Unit vector; a zero vector stays zero, as with an epsilon-guarded division."""
    return F.transform(vec, lambda x: x / F.greatest(norm(vec), F.lit(1e-12)))


def angle_degrees(cosine: Column) -> Column:
    """Angle of a cosine, clamped into [-1, 1] so that rounding cannot give NaN."""
    return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)
