"""Arrays of numbers as vectors, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def logsumexp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.ln(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def softmax_max(v: Column) -> Column:
    return F.exp(F.array_max(v) - logsumexp(v))


def median(v: Column) -> Column:
    """Middle of the values, mean of the two middle ones; null when empty."""
    s, n = F.array_sort(v), F.size(v)
    low, high = F.try_element_at(s, F.floor((n + 1) / 2).cast("int")), F.try_element_at(s, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
