"""Vector and packed-tensor expressions. A tensor (G, q, S) is packed with index (g q + j) S + s."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def kronecker(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def l1_normalized(v: Column) -> Column:
    """Over the sum of magnitudes, signed so that the largest entry (the first among equals) is positive; all zeros stay."""
    size = total(F.transform(v, F.abs))
    top = F.element_at(F.filter(v, lambda x: F.abs(x) == F.array_max(F.transform(v, F.abs))), 1)
    return F.when(size > 0, F.transform(v, lambda x: x * F.sign(top) / F.when(size > 0, size))).otherwise(v)


def soft(x: Column, by: Column) -> Column:
    return F.sign(x) * F.greatest(F.abs(x) - by, F.lit(0.0))


def block_soft(block: Column, by: Column) -> Column:
    """A block of coefficients shrunk towards zero by its norm."""
    norm = F.sqrt(total(F.transform(block, lambda v: v * v)))
    return F.transform(block, lambda v: F.when(norm > by, v * (1 - by / F.when(norm > by, norm))).otherwise(0.0))


def guarded(x: Column, least: float = 1e-10) -> Column:
    """A denominator, or 1 where it is tiny."""
    return F.when(x > least, x).otherwise(1.0)


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounded to the nearest, halves to the even neighbour: 2.5 is 2."""
    return F.bround(x, digits)
