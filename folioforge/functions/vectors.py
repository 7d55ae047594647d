"""Vector functions in double precision, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def same_length(a: Column, b: Column) -> Column:
    """Vectors pair element by element, and zip_with would pad the shorter with nulls; so lengths are checked."""
    return F.size(a) == F.size(b)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; null if either is null or lengths differ."""
    squares = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.when(same_length(a, b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either is null or zero or lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(same_length(a, b) & (norm > 0), dot(a, b) / norm)
