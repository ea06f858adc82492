"""Array arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(a: Column) -> Column:
    """Divided by the norm, which counts as 1e-6 at least, and as that where it is not finite."""
    norm = F.sqrt(dot(a, a))
    norm = F.when(F.isnan(norm) | (norm == float("inf")), F.lit(1e-6)).otherwise(F.greatest(norm, F.lit(1e-6)))
    return F.transform(a, lambda x: x.cast("double") / norm)


def softmax(a: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def log_softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(a, lambda x: x - top - F.log(total))


def argmax(a: Column) -> Column:
    """Index of the largest element, the first of equals, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def glu(a: Column) -> Column:
    """First half times the sigmoid of the second half."""
    half = (F.size(a) / 2).cast("int")
    return F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda x, g: x * sigmoid(g))
