"""Vector expressions; numbers are widened to double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine; 0 where the lengths differ or a vector is all zero, null where one is null."""
    size = norm(a) * (norm(b) if norm_b is None else norm_b)
    return F.when(F.size(a) != F.size(b), 0.0).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """The vector at length one; an all-zero vector stays as it is."""
    size = norm(a)
    return F.when(size == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def usable(a: Column, dims: Column | int) -> Column:
    """Whether a vector has the right length, finite numbers only, and isn't all zero."""
    size = norm(a)
    return F.coalesce((F.size(a) == dims) & (size > 0) & ~F.isnan(size) & (size < float("inf")), F.lit(False))
