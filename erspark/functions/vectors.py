"""Vectors as arrays: norms, prefixes, weights and eight-bit forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length 1; the zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def truncated(v: Column, dim: int) -> Column:
    return unit(F.slice(v, 1, dim))


def quantized(v: Column) -> Column:
    """Eight-bit form of a unit vector."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x.cast("double") * 127).cast("int"))))


def dequantized(q: Column) -> Column:
    return unit(F.transform(q, lambda x: x / F.lit(127.0)))


def quantized_by_row(v: Column) -> Column:
    """Eight-bit form scaled by the row's largest entry."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.transform(v, lambda x: F.rint(127 * x.cast("double") / F.when(top == 0, F.lit(1.0)).otherwise(top)).cast("int"))


def combined(name: Column, address: Column, weight: float) -> Column:
    """Unit vector whose inner products weigh the two parts' by ``weight`` and 1 - ``weight``."""
    return F.concat(F.transform(name, lambda x: x * weight**0.5), F.transform(address, lambda x: x * (1 - weight) ** 0.5))
