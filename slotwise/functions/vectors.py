"""Vectors as array columns; sums are taken in doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def once(v: Column, f: Callable[[Column], Column]) -> Column:
    """f of v, which is evaluated once a row; in a lambda, Spark would evaluate it again for each element."""
    return F.get(F.transform(F.array(v), f), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """v less its mean, over the root of its variance plus eps."""

    def over(v: Column) -> Column:
        n = F.size(v).cast("double")
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
        spread = lambda mean: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean + eps)
        return once(mean, lambda mean: once(spread(mean), lambda spread: F.transform(v, lambda x: (x - mean) / spread)))

    return once(v, over)


def times(matrix: Column, v: Column) -> Column:
    """The products of an array of rows with v."""
    return once(v, lambda v: F.transform(matrix, lambda row: dot(row, v)))


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    return once(v, lambda v: once(norm(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)))
