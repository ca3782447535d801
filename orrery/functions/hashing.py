"""Random draws as hashes of row keys: the same rows come out under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw64(seed: int, *parts: str | Column) -> Column:
    return F.xxhash64(F.lit(seed).cast("bigint"), *parts)


def uniform(seed: int, *parts: str | Column) -> Column:
    """Uniform in (0, 1): the top 53 bits of the hash, shifted by half a step."""
    return (F.shiftrightunsigned(draw64(seed, *parts), 11).cast("double") + 0.5) * (2.0**-53)


def standard_normal(seed: int, *parts: str | Column) -> Column:
    """Box-Muller on two independent hash uniforms."""
    u1, u2 = uniform(2 * seed, *parts), uniform(2 * seed + 1, *parts)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)


def poisson_weight(seed: int, rate: float, *parts: str | Column) -> Column:
    """Poisson draw with a fixed rate, by inversion of its cumulative probabilities."""
    u = uniform(seed, *parts)
    p = math.exp(-rate)
    total, k = p, 0
    steps: Column | None = None
    while 1.0 - total > 1e-15 and k < 200:
        steps = F.when(u < total, F.lit(k)) if steps is None else steps.when(u < total, F.lit(k))
        k += 1
        p *= rate / k
        total += p
    return steps.otherwise(F.lit(k))
