"""Aggregate expressions that return null, not an error, on empty or constant groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(value: Column, *others: Column) -> Column:
    """``value`` where all the others are present too."""
    present = value.isNotNull()
    for other in others:
        present = present & other.isNotNull()
    return F.when(present, value)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are present; null for a constant side."""
    x, y = mask(x, y), mask(y, x)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def weighted_avg(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
