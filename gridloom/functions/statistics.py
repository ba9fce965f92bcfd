"""Statistics that Spark lacks or defines otherwise than data frames and SQL databases do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skewness(value: Column) -> Column:
    """Bias-corrected sample skewness; null under three values."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; null under four values."""
    n = F.count(value).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))


def standard_error(value: Column) -> Column:
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def share_numeric(value: Column) -> Column:
    """Share of all rows whose value reads as a number."""
    return F.avg(value.cast("string").try_cast("double").isNotNull().cast("double"))
