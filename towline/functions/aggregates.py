"""Sums, means and counts with a stated treatment of NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import as_column


def sum_of(col, skip_null: bool) -> Column:
    """Sum; strict gives NULL if any value is NULL, skipping gives 0 if all are."""
    column = as_column(col)
    if skip_null:
        return F.coalesce(F.sum(column), F.lit(0).cast("double"))
    return F.when(~F.bool_or(column.isNull()), F.sum(column))


def mean_of(col, skip_null: bool) -> Column:
    """Mean; strict gives NULL if any value is NULL."""
    column = as_column(col)
    if skip_null:
        return F.avg(column)
    return F.when(~F.bool_or(column.isNull()), F.avg(column))


def n_distinct(col) -> Column:
    """Exact number of distinct values, NULL counting as one value."""
    column = as_column(col)
    return F.countDistinct(column) + F.max(column.isNull().cast("bigint"))
