"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def doubles(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: str | Column) -> Column:
    """To unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def distance_score(a: str | Column, b: str | Column) -> Column:
    """1 - d*d/2, in [-1, 1]: the cosine of unit vectors."""
    return 1 - squared_distance(a, b) / 2


def rescale(value: Column, low: Column, high: Column) -> Column:
    """To [0, 1]; all 0 if the values hardly differ."""
    return F.when(high - low < 1e-12, F.lit(0.0)).otherwise((value - low) / (high - low))
