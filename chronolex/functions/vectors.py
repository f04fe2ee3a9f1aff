"""Vector arithmetic on array<double> columns with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [-1, 1]; null if a vector is zero or either holds something that isn't finite."""
    c = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when(c.isNotNull() & ~F.isnan(c), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def unit_norm(v: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def head_normalised(v: Column, dims: int) -> Column:
    """The first ``dims`` components at length one."""
    head = F.slice(v, 1, dims)
    return F.transform(head, lambda x: x / norm(head))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def parse_vector(text: Column) -> Column:
    """``[a,b,...]`` as written by vector extensions of databases."""
    return F.from_json(text, "array<double>")
