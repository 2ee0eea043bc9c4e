"""Expressions over arrays of doubles, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(a: Column) -> Column:
    """a over its length; an all-zero vector stays zero."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


def rounded(a: Column, digits: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x, digits))


def one_hot_label(x: Column) -> Column:
    """Index of the single 1 of a one-hot row; anything else is an error."""
    total = F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))
    return F.when(F.assert_true(total == 1).isNull(), F.array_position(x, 1) - 1).cast("int")
