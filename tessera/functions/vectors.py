"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    """v at length 1, so that a dot product is a cosine; null where v is null or has no length."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v)))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine similarity; 0 for empty vectors and unequal lengths."""
    value = dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), value).otherwise(F.lit(0.0))
