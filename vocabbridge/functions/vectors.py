"""Expressions on dense vectors held as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column, length: Column | None = None) -> Column:
    """``v`` scaled to length 1; null for a zero vector."""
    size = norm(v) if length is None else length
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def add(a: Column, b: Column) -> Column:
    """Element-wise sum."""
    return F.zip_with(a, b, lambda x, y: x + y)


def to_text(v: Column) -> Column:
    """Components joined with one space."""
    return F.array_join(v.cast("array<string>"), " ")
