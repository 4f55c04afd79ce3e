"""Vectors as array columns. Elements are widened to doubles first, so that distinct similarities stay distinct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; an all-zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a vector of length 0."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def usable(vec: Column, width: int) -> Column:
    """Of the width, without null or NaN elements, not all zero."""
    return F.coalesce((F.size(vec) == width) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)) & F.exists(vec, lambda x: x != 0), F.lit(False))
