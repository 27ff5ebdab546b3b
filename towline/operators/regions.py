"""Names of the boxes that points lie in, for tables of any number of boxes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

WORLD = 360.0  # degrees; positions beyond half of it count to the outermost cells
LEVELS = 24
_BOX = "name string, priority bigint, " + ", ".join(f"{axis}_{end} double, {axis}_{end}_open boolean" for axis in ("lat", "lon") for end in ("low", "high"))


def box_table(spark: SparkSession, rules: Iterable[tuple]) -> DataFrame:
    """Boxes of rules `(name, [(axis, comparison, limit)])`; later rules have priority. A missing bound is NULL."""
    rows = []
    for priority, (name, bounds) in enumerate(rules):
        ends = {}
        for axis, comparison, limit in bounds:
            for end, sign in (("low", 1), ("high", -1)):
                if comparison == "=" or comparison[0] == (">" if end == "low" else "<"):
                    tight = (sign * float(limit), comparison in ("<", ">"))
                    ends[axis, end] = max(ends.get((axis, end), tight), tight)
        row = [name, priority]
        for axis in ("lat", "lon"):
            for end, sign in (("low", 1), ("high", -1)):
                limit, is_open = ends.get((axis, end), (None, False))
                row += [None if limit is None else sign * limit, is_open]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, _BOX)


def _clamped(x: Column) -> Column:
    return F.least(F.greatest(x.cast("double"), F.lit(-WORLD / 2)), F.lit(WORLD / 2))


def _cell(x: Column, level: Column) -> Column:
    return F.floor((_clamped(x) + WORLD / 2) / WORLD * F.pow(F.lit(2.0), level)).cast("bigint")


def _inside(axis: str) -> Column:
    """The exact test on one axis. A missing bound holds for any position, also a NULL one."""
    x, low, high = F.col(f"__{axis}"), F.col(f"{axis}_low"), F.col(f"{axis}_high")
    above = low.isNull() | (x > low) | (~F.col(f"{axis}_low_open") & (x == low))
    return above & (high.isNull() | (x < high) | (~F.col(f"{axis}_high_open") & (x == high)))


def classify_by_boxes(df: DataFrame, lat: str, lon: str, boxes: DataFrame, out: str = "region") -> DataFrame:
    """Name the box a point lies in, by an equi-join on grid cells. Of several boxes that with the greatest priority wins.

    `boxes` has the columns of `box_table`. A box stands at the grid level whose cells are at least as wide as it is, in at
    most four cells, and a point looks into one cell of each level in use; matches are then tested exactly. Only distinct
    positions are looked up, so that a station with very many rows is one of them. Points in no box get NULL. Equal priorities go to the
    greatest name. No columns of `df` but `lat` and `lon` are read, and an empty table of boxes gives NULL throughout.
    """
    extent = F.greatest(*[
        _clamped(F.coalesce(F.col(f"{axis}_high"), F.lit(WORLD))) - _clamped(F.coalesce(F.col(f"{axis}_low"), F.lit(-WORLD))) for axis in ("lat", "lon")])
    # A box with its bounds the wrong way round holds no point; its extent may be anything.
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(F.lit(WORLD) / F.greatest(extent, F.lit(1e-9)))))).cast("int")
    placed = boxes.withColumn("__level", level)
    for axis in ("lat", "lon"):
        low = _cell(F.coalesce(F.col(f"{axis}_low"), F.lit(-WORLD)), F.col("__level"))
        high = _cell(F.coalesce(F.col(f"{axis}_high"), F.lit(WORLD)), F.col("__level"))
        placed = placed.filter(low <= high).withColumn(f"__{axis}_cell", F.explode(F.sequence(low, high)))
    placed = cut(placed)
    # At most LEVELS + 1 numbers.
    levels = sorted(r[0] for r in placed.select("__level").distinct().collect())
    if not levels:
        return df.withColumn(out, F.lit(None).cast("string"))
    points = df.select(F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon")).distinct()
    visits = points.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels])))
    for axis in ("lat", "lon"):
        # A NULL position only lies in boxes without bounds on its axis, which stand in all cells of it.
        visits = visits.withColumn(f"__{axis}_cell", _cell(F.coalesce(F.col(f"__{axis}"), F.lit(0.0)), F.col("__level")))
    found = visits.join(placed, ["__level", "__lat_cell", "__lon_cell"]).filter(_inside("lat") & _inside("lon"))
    named = cut(found.groupBy("__lat", "__lon").agg(F.max(F.struct("priority", "name")).alias("__best")).select("__lat", "__lon", F.col("__best.name").alias("__name")))
    same = F.col(lat).cast("double").eqNullSafe(F.col("__lat")) & F.col(lon).cast("double").eqNullSafe(F.col("__lon"))
    return df.join(named, same, "left").select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__name").alias(out))
