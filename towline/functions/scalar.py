"""Scalar expressions. All stay inside the JVM."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq}


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cpue(count, cells, dilution, volume) -> Column:
    """Catch per unit effort; NULL where no cell was counted or no water was sampled."""
    per_cell = F.try_divide(as_column(count), as_column(cells))
    return F.try_divide(per_cell * as_column(dilution), as_column(volume))


def paste(*cols, sep: str = " ") -> Column:
    """Join values into one label; a NULL becomes the text `NA` and never swallows the label."""
    return F.concat_ws(sep, *[F.coalesce(as_column(c).cast("string"), F.lit("NA")) for c in cols])


def strip_token(col, token: str) -> Column:
    """Remove every occurrence of a literal substring."""
    return F.replace(as_column(col), F.lit(token), F.lit(""))


def recode(col, mapping: Mapping) -> Column:
    """Replace listed values; keep all others, NULL included."""
    column = as_column(col)
    if not mapping:
        return column
    cells = [F.lit(part) for item in mapping.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*cells), column), column)


def override(df: DataFrame, col: str, condition: Column, value) -> DataFrame:
    """Set a column where a condition is TRUE; FALSE and NULL leave it as it is."""
    return df.withColumn(col, F.when(condition, F.lit(value)).otherwise(F.col(col)))


def as_levels(
    df: DataFrame, col: str, levels: Sequence, labels: Sequence[str] | None = None, out: str | None = None
) -> DataFrame:
    """Ordered category: label column `out` plus its position `<out>_ord`; unlisted values give NULL."""
    target = out or col
    names = list(labels) if labels is not None else [str(v) for v in levels]
    if len(names) != len(levels):
        raise ValueError("one label per level")
    position = F.array_position(F.array([F.lit(v) for v in levels]), F.col(col)).cast("int")
    order = F.when(position > 0, position)
    label = F.try_element_at(F.array([F.lit(n) for n in names]), order)
    return df.withColumns({f"{target}_ord": order, target: label})


def _number(value) -> str:
    return f"{value:g}"


def cut(col, breaks: Sequence[float]) -> Column:
    """Right-closed bins labelled `(a,b]`; the lowest break itself and values outside give NULL."""
    column = as_column(col)
    ladder = None
    for low, high in zip(breaks, breaks[1:]):
        inside = (column > F.lit(float(low))) & (column <= F.lit(float(high)))
        label = F.lit(f"({_number(low)},{_number(high)}]")
        ladder = F.when(inside, label) if ladder is None else ladder.when(inside, label)
    return ladder


def classify_boxes(df: DataFrame, lat: str, lon: str, rules, out: str = "region") -> DataFrame:
    """Name the box a point lies in. Rules are `(name, [(axis, comparison, limit)])`; the last match wins."""
    axes = {"lat": F.col(lat), "lon": F.col(lon)}
    ladder = None
    for name, bounds in reversed(list(rules)):
        inside = F.lit(True)
        for axis, comparison, limit in bounds:
            inside = inside & _COMPARE[comparison](axes[axis], F.lit(float(limit)))
        ladder = F.when(inside, F.lit(name)) if ladder is None else ladder.when(inside, F.lit(name))
    return df.withColumn(out, ladder if ladder is not None else F.lit(None).cast("string"))


def drop_prefix(df: DataFrame, prefix: str, ignore_case: bool = True) -> DataFrame:
    """Drop all columns whose name starts with a prefix."""
    fold = str.lower if ignore_case else str
    return df.select([F.col(f"`{c}`") for c in df.columns if not fold(c).startswith(fold(prefix))])


def relative_to_mean(df: DataFrame, col: str, out: str = "relative", offset: float = 0.1) -> DataFrame:
    """Add `offset + x / mean(x)` and the range `max - min` over the whole table.

    The table-wide values are one-row scalar subqueries: no shuffle of the rows, no join.
    """
    mean = df.agg(F.avg(col)).scalar()
    span = df.agg(F.max(col) - F.min(col)).scalar()
    return df.withColumns({out: F.lit(offset) + F.try_divide(F.col(col), mean), f"{out}_range": span})
