"""Random numbers as expressions: a draw is a function of (seed, row, place).

The first 52 bits of an MD5 make a number that every engine computes alike, so
generated rows don't depend on partitions, retries or the order of evaluation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, row: Column | str, place: int) -> Column:
    """A double in [0, 1)."""
    row = F.col(row) if isinstance(row, str) else row
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), row.cast("string"), F.lit(f":{place}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def between(seed: int, row: Column | str, place: int, low: float, high: float) -> Column:
    return F.lit(low) + F.lit(high - low) * uniform(seed, row, place)


def below(seed: int, row: Column | str, place: int, n: int) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(seed, row, place) * n).cast("int")


def exponential(seed: int, row: Column | str, place: int, mean: float) -> Column:
    return -F.lit(mean) * F.log(1 - uniform(seed, row, place))


def normal(seed: int, row: Column | str, place: int) -> Column:
    """Standard normal by Box and Muller; takes places `place` and `place` + 1."""
    first = F.greatest(1 - uniform(seed, row, place), F.lit(1e-12))
    return F.sqrt(-2 * F.log(first)) * F.cos(F.lit(2 * math.pi) * uniform(seed, row, place + 1))


def lognormal(seed: int, row: Column | str, place: int, mu: float, sigma: float) -> Column:
    return F.exp(F.lit(mu) + F.lit(sigma) * normal(seed, row, place))


def pick(seed: int, row: Column | str, place: int, values: list) -> Column:
    """One of the values."""
    return F.element_at(F.array(*map(F.lit, values)), below(seed, row, place, len(values)) + 1)
