"""Tables drawn on top of an ordination."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def taxon_scores(coords: DataFrame, long: DataFrame, axes: Sequence[str] = ("axis1", "axis2"),
                 unit: str = "unit", taxon: str = "taxon", x: str = "x") -> DataFrame:
    """Position of each taxon: mean of the unit coordinates weighted by abundance."""
    weighted = long.join(coords.select(unit, *axes), unit)
    return weighted.groupBy(taxon).agg(*[F.try_divide(F.sum(F.col(x) * F.col(a)), F.sum(x)).alias(a) for a in axes])


def group_ellipse(coords: DataFrame, groups: DataFrame, group: str = "group", conf: float = 0.95,
                  axes: Sequence[str] = ("axis1", "axis2"), unit: str = "unit") -> DataFrame:
    """Centre, half axes and angle of the ellipse that holds a share of each group under normality."""
    a, b = axes
    joined = coords.select(unit, a, b).join(groups.select(unit, group), unit)
    stats = joined.groupBy(group).agg(
        F.avg(a).alias("center1"), F.avg(b).alias("center2"), F.var_samp(a).alias("v11"),
        F.var_samp(b).alias("v22"), F.covar_samp(a, b).alias("v12"), F.count(F.lit(1)).alias("n"),
    )
    middle = (F.col("v11") + F.col("v22")) / 2
    half = F.hypot((F.col("v11") - F.col("v22")) / 2, F.col("v12"))
    scale = math.sqrt(-2 * math.log(1 - conf))
    return stats.select(
        group, "n", "center1", "center2",
        (F.lit(scale) * F.sqrt(middle + half)).alias("major"),
        (F.lit(scale) * F.sqrt(F.greatest(middle - half, F.lit(0.0)))).alias("minor"),
        (F.atan2(2 * F.col("v12"), F.col("v11") - F.col("v22")) / 2).alias("angle"),
    )


def group_spider(coords: DataFrame, groups: DataFrame, group: str = "group",
                 axes: Sequence[str] = ("axis1", "axis2"), unit: str = "unit") -> DataFrame:
    """A segment from every unit to the centre of its group."""
    a, b = axes
    joined = coords.select(unit, a, b).join(groups.select(unit, group), unit)
    # Centres are aggregated and joined back, so that one large group is not one window task.
    centers = cut(joined.groupBy(group).agg(F.avg(a).alias("center1"), F.avg(b).alias("center2")))
    return joined.join(centers, group).select(unit, group, a, b, "center1", "center2")


def surface_grid(coords: DataFrame, env: DataFrame, col: str, nx: int = 10, ny: int = 10,
                 axes: Sequence[str] = ("axis1", "axis2"), unit: str = "unit") -> DataFrame:
    """Mean of an environment variable in each cell of a grid over the ordination."""
    a, b = axes
    joined = coords.select(unit, a, b).join(env.select(unit, col).filter(F.col(col).isNotNull()), unit)

    def cell(axis: str, steps: int):
        low = coords.agg(F.min(axis)).scalar()
        high = coords.agg(F.max(axis)).scalar()
        place = F.floor(F.try_divide((F.col(axis) - low) * steps, high - low))
        return F.least(F.coalesce(place, F.lit(0)), F.lit(steps - 1)).cast("int")

    return joined.groupBy(cell(a, nx).alias("gx"), cell(b, ny).alias("gy")).agg(
        F.avg(col).alias("mean"), F.count(F.lit(1)).alias("n")
    )
