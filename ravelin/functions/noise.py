"""Random numbers as expressions of a seed and keys: the same for the same keys, however rows are dealt over partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A double inside (0, 1) from 53 bits of a hash of seed and keys."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number by Box and Muller from two uniforms of the same keys."""
    return F.sqrt(-2 * F.log(uniform(2 * seed, *keys))) * F.cos(2 * math.pi * uniform(2 * seed + 1, *keys))


def noisy(x: Column, sigma: float, seed: int, *keys: Column) -> Column:
    """An array with normal noise of deviation ``sigma`` on each entry, by its place; an entry that is null stays null."""
    return F.transform(x, lambda v, k: v + F.lit(float(sigma)) * normal(seed, *keys, k))
