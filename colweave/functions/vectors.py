"""Arithmetic on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def linear(h: Column, weights, bias=None) -> Column:
    """``W h (+ b)`` for a weight matrix given as rows, one per output."""
    outs = []
    for o, row in enumerate(weights):
        value = dot(h, literal_vector(row))
        outs.append(value if bias is None else value + F.lit(float(bias[o])))
    return F.array(*outs)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1.0)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))
