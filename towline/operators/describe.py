"""Exact five-number summaries without gathering a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reshape import to_long

_BINS = 512


def order_statistics(values: DataFrame, ranks: dict[str, list[int]], bounds: dict[str, tuple]) -> dict:
    """Exact values at 0-based ranks, per column of a long `(column, value)` table.

    Every round counts the values inside each open bracket over equal-width bins and keeps the bin
    that holds the rank, with the smallest and largest value seen in it, until both agree. A round is
    one pass with map-side counting; the driver sees bin counts only.
    """
    found: dict[tuple[str, int], float] = {}
    # Open brackets: (column, low, high) -> (values below low, ranks inside).
    brackets = {}
    for column, wanted in ranks.items():
        low, high = bounds[column]
        brackets[(column, low, high)] = (0, sorted(set(wanted)))
    while brackets:
        ordered = list(brackets)
        bracket = F.lit(None).cast("int")
        bin_number = F.lit(None).cast("int")
        for number, (column, low, high) in enumerate(ordered):
            inside = (F.col("column") == column) & F.col("value").between(low, high)
            scaled = (F.col("value") / 2 - low / 2) / (high / 2 - low / 2) if high > low else F.lit(0.0)
            place = F.least(F.floor(scaled * _BINS), F.lit(_BINS - 1)).cast("int")
            bracket = F.when(inside, F.lit(number)).otherwise(bracket)
            bin_number = F.when(inside, place).otherwise(bin_number)
        counted = (
            values.select(bracket.alias("bracket"), bin_number.alias("bin"), "value")
            .filter(F.col("bracket").isNotNull())
            .groupBy("bracket", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
            .orderBy("bracket", "bin")
            .collect()
        )
        narrowed = {}
        for number, key in enumerate(ordered):
            below, wanted = brackets[key]
            for row in (r for r in counted if r["bracket"] == number):
                inside = [r for r in wanted if below <= r < below + row["n"]]
                if inside:
                    if row["low"] == row["high"]:
                        found.update({(key[0], r): row["low"] for r in inside})
                    elif row["n"] == 2:
                        found.update({(key[0], r): row["low"] if r == below else row["high"] for r in inside})
                    else:
                        narrowed[(key[0], row["low"], row["high"])] = (below, inside)
                below += row["n"]
        brackets = narrowed
    return found


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbouring order statistics."""
    long = to_long(df.select([F.col(c).cast("double").alias(c) for c in cols]), [], cols, "column", "value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    spans = {
        r["column"]: r
        for r in long.groupBy("column")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()
    }
    ranks = {
        c: [k for p in probs for k in (math.floor((s["n"] - 1) * p), math.ceil((s["n"] - 1) * p))]
        for c, s in spans.items()
    }
    found = order_statistics(long, ranks, {c: (s["low"], s["high"]) for c, s in spans.items()})
    result = {}
    for c in cols:
        if c not in spans:
            result[c] = [None] * len(probs)
            continue
        cuts = []
        for p in probs:
            place = (spans[c]["n"] - 1) * p
            low, high = found[(c, math.floor(place))], found[(c, math.ceil(place))]
            cuts.append(low + (high - low) * (place - math.floor(place)))
        result[c] = cuts
    return result


def describe_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of NULLs of each numeric column."""
    if cols is None:
        cols = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    quartiles = exact_quantiles(df, cols, [0.0, 0.25, 0.5, 0.75, 1.0])
    totals = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"mean_{i}") for i, c in enumerate(cols)],
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(cols)],
    ).first()
    rows = [
        (c, quartiles[c][0], quartiles[c][1], quartiles[c][2], totals[f"mean_{i}"], quartiles[c][3],
         quartiles[c][4], totals[f"nulls_{i}"])
        for i, c in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, min double, q1 double, median double, mean double, q3 double, max double, n_null bigint"
    )
