"""Aggregate expressions that Spark has only in another form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew(x: Column) -> Column:
    """Bias-corrected sample skewness."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def excess_kurtosis(x: Column) -> Column:
    """Bias-corrected sample excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def share(condition: Column) -> Column:
    """Share of rows with a value for which ``condition`` holds."""
    return F.try_divide(F.count_if(condition).cast("double"), F.count(condition))
