"""Vector operations on array columns; everything stays in JVM higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def vsum(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def scale(v: Column, k) -> Column:
    return F.transform(v, lambda x: x * k)


def add_scaled(a: Column, b: Column, k) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * k)


def normalize(v: Column) -> Column:
    """Scale to sum 1; a zero vector becomes uniform."""
    total = vsum(v)
    return F.transform(v, lambda x: F.when(total != 0, x / total).otherwise(1.0 / F.size(v)))


def argmax(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def argmin(v: Column) -> Column:
    return F.array_position(v, F.array_min(v)) - 1


def entropy(p: Column) -> Column:
    """Shannon entropy in bits; zero cells add nothing."""
    return -vsum(F.transform(p, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)))


def relative_entropy(p: Column, q: Column) -> Column:
    return vsum(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log2(x / y)).otherwise(0.0)))


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(vsum(F.transform(v, lambda x: F.exp(x - top))))


def cdf(p: Column) -> Column:
    """Running sums of a probability vector."""
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: vsum(F.slice(p, 1, i)))
