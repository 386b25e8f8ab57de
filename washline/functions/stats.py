"""Bias-corrected moments, in the sample form that data-frame users expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skewness(c: Column) -> Column:
    """Adjusted Fisher-Pearson skewness G1; NULL below three values or without spread."""
    n = F.count(c).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n > 2, F.skewness(c) * factor)


def kurtosis(c: Column) -> Column:
    """Excess kurtosis G2; NULL below four values or without spread."""
    n = F.count(c).cast("double")
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n > 3, factor * ((n + 1) * F.kurtosis(c) + 6))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are present; 0 where either has no spread."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))
