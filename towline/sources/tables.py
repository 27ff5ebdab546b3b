"""Typed and inferred scans of survey extracts, and the sinks between jobs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _typed(name: str, dtype: T.DataType, date_format: str | None, timestamp_format: str | None) -> Column:
    """Text cell to its declared type; a cell that does not parse becomes NULL."""
    text = F.trim(F.col(f"`{name}`"))
    if isinstance(dtype, T.StringType):
        return F.col(f"`{name}`")
    if isinstance(dtype, T.DateType):
        if date_format:
            return F.try_to_timestamp(text, F.lit(date_format)).cast("date")
        return text.try_cast("date")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        parsed = F.try_to_timestamp(text, F.lit(timestamp_format)) if timestamp_format else text.try_cast("timestamp")
        return parsed.cast(dtype)
    if isinstance(dtype, T.NumericType):
        # A grouping comma stands before three digits.
        text = F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?!\d))", "")
    return text.try_cast(dtype)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    null_values: Iterable[str] = ("", "NA"),
    format: str | None = None,
    date_format: str | None = None,
    timestamp_format: str | None = None,
) -> DataFrame:
    """Read one CSV or Parquet table (a spreadsheet sheet lands as one of these).

    With a schema, CSV cells are read as text, the null tokens become NULL and every other cell is
    cast leniently, so a malformed cell is NULL and not a failed job. Columns are matched by header
    name, so files whose column order differs are safe. Without a schema types are inferred.
    """
    tokens = list(null_values)
    kind = format or ("parquet" if str(path).rstrip("/").endswith(".parquet") else "csv")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if kind == "parquet":
        table = spark.read.parquet(path)
        if schema is None:
            return table
        return table.select([F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
    reader = spark.read.option("header", True)
    if schema is None:
        return _inferred(reader.option("inferSchema", False).csv(path), tokens)
    table = reader.option("inferSchema", False).csv(path)
    missing = [f.name for f in schema if f.name not in table.columns]
    if missing:
        raise ValueError(f"{path}: no column named {missing}")
    blanked = table.select(
        [F.when(~F.col(f"`{f.name}`").isin(tokens), F.col(f"`{f.name}`")).alias(f.name) for f in schema]
    )
    return blanked.select([_typed(f.name, f.dataType, date_format, timestamp_format).alias(f.name) for f in schema])


def _inferred(table: DataFrame, tokens: list[str]) -> DataFrame:
    """Text columns with every null token blanked, as the narrowest type that all remaining values of a column have."""
    blanked = table.select([F.when(~F.col(f"`{c}`").isin(tokens), F.trim(f"`{c}`")).alias(c) for c in table.columns])
    kinds = ("int", "bigint", "double", "boolean", "date", "timestamp")
    counts = blanked.agg(*[
        F.count(F.col(f"`{c}`") if kind == "string" else F.col(f"`{c}`").try_cast(kind)).alias(f"{i}_{kind}")
        for i, c in enumerate(table.columns) for kind in ("string", *kinds)
    ]).first()
    chosen = [next((k for k in kinds if counts[f"{i}_string"] and counts[f"{i}_{k}"] == counts[f"{i}_string"]), "string") for i in range(len(table.columns))]
    original = [F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")) for c in table.columns]
    return table.select([(x if k == "string" else x.try_cast(k)).alias(c) for x, k, c in zip(original, chosen, table.columns)])


def save_table(df: DataFrame, path: str, partition_by: Iterable[str] = (), mode: str = "overwrite") -> None:
    """Keep an intermediate table for the next job; partition a large catch table by year."""
    writer = df.write.mode(mode)
    keys = list(partition_by)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no row names; NULL is written as NA."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)
