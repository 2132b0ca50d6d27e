"""Vector functions as column expressions over arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def magnitude(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), magnitude(a) * magnitude(b)), F.lit(0.0))


def normalize(v: Column) -> Column:
    """Unit length; a zero or empty vector is returned as it is."""
    n = magnitude(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def is_normalized(v: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(magnitude(v) - 1.0) <= tolerance


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def scale(v: Column, k: float | Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * k)


def blend(text: Column, image: Column, text_weight: float = 0.6) -> Column:
    """A weighted mix of two vectors, of unit length."""
    return normalize(F.zip_with(text, image, lambda x, y: x.cast("double") * text_weight + y.cast("double") * (1 - text_weight)))


def score(metric: str, a: Column, b: Column) -> Column:
    """Higher is nearer; what is not finite scores 0."""
    if metric == "cosine":
        value = cosine(a, b)
    elif metric == "dot":
        value = dot(a, b)
    elif metric == "l2":
        value = -squared_distance(a, b)
    else:
        raise ValueError(f"no metric {metric!r}")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
