"""Column expressions of the statistics that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FUZZ_DIGITS = 10
"""Quantile breaks are rounded to so many decimals, so that interpolation noise moves no value across one."""


def quantiles(value: str | Column, probs: list[float]) -> Column:
    """Type-7 quantiles as an array aggregate."""
    return F.transform(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])), lambda q: F.round(q, FUZZ_DIGITS))


def bin_of(x: Column, breaks: Column) -> Column:
    """The right-closed bin (from 1, the lowest value included) of ``x`` among ascending breaks; null outside."""
    inner = F.filter(breaks, lambda b, i: (i > 0) & (i < F.size(breaks) - 1) & (x > b))
    inside = (x >= F.element_at(breaks, 1)) & (x <= F.element_at(breaks, -1))
    return F.when(inside, F.size(inner) + 1)


def moment(x: str, mean: str, sd: str, n: str, power: int) -> Column:
    """Sum of the power of deviations over (n - 1) sd^power, as an aggregate over joined statistics."""
    return F.sum(F.pow(F.col(x) - F.col(mean), power) / ((F.col(n) - 1) * F.pow(F.col(sd), power)))
