"""Inline lookup tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixed import SEASON_OF_MONTH


def lookup_df(spark: SparkSession, mapping: Mapping, key: str = "key", value: str = "value") -> DataFrame:
    """A small mapping as a table, for use with `natural_join`."""
    return spark.createDataFrame(list(mapping.items()), [key, value])


def lookup_value(col: Column | str, mapping: Mapping) -> Column:
    """Look a value up in an inline mapping; a key that is not listed gives NULL."""
    column = F.col(col) if isinstance(col, str) else col
    if not mapping:
        return F.lit(None)
    cells = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*cells), column)


def season_of(month: Column | str) -> Column:
    """Season name of a month number."""
    column = F.col(month) if isinstance(month, str) else month
    return lookup_value(column.cast("int"), SEASON_OF_MONTH)
