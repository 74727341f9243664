"""Quotients and correlations that read NULL, not an error, on a zero denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson over complete pairs; NULL when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return over(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
