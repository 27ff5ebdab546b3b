"""Filters that state what happens to NULL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import as_column


def not_in(col, values: Iterable) -> Column:
    """Exclude listed values but keep NULL rows."""
    return F.coalesce(~as_column(col).isin(list(values)), F.lit(True))


def between_open(col, low, high) -> Column:
    """Strictly between two bounds."""
    column = as_column(col)
    return (column > F.lit(low)) & (column < F.lit(high))


def is_present(col) -> Column:
    """Neither NULL nor an empty text."""
    column = as_column(col)
    return column.isNotNull() & (column.cast("string") != F.lit(""))


def complete_cases(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Rows without NULL (or NaN) in the chosen columns."""
    return df.dropna(how="any", subset=list(cols) if cols is not None else None)
