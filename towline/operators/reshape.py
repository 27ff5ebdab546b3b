"""Wide and long shapes, stacking, ordering and balanced designs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def to_long(
    df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str], names_to: str = "name", values_to: str = "value"
) -> DataFrame:
    """One row per identifier and value column."""
    return df.unpivot(list(id_cols), list(value_cols), names_to, values_to)


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from `first` to `last`, for `to_long`."""
    names = df.columns
    return names[names.index(first): names.index(last) + 1]


def community_matrix(
    df: DataFrame,
    id_cols: Sequence[str],
    names_from: str,
    values_from: str,
    taxa: Sequence[str],
    fill: float | None = 0.0,
) -> DataFrame:
    """One row per sampling unit and one column per listed taxon; cells that collide are summed.

    The taxa are stated, so no extra pass discovers them and the column order is fixed. A cell no row
    reaches holds `fill`. For more than a few hundred taxa use `community_long`.
    """
    wide = df.groupBy(*id_cols).pivot(names_from, list(taxa)).agg(F.sum(values_from))
    return wide if fill is None else wide.na.fill(float(fill), list(taxa))


def community_long(
    df: DataFrame, unit: str, taxon: str, x: str, zero_fill: bool = False, taxa: Sequence[str] | None = None
) -> DataFrame:
    """`(unit, taxon, x)` with one row per pair; `zero_fill` adds the absent taxa of every unit.

    The catch is aggregated and written once; its units and taxa are read off that. A unit whose rows all lack a taxon has
    zeros only.
    """
    long = df.groupBy(unit, taxon).agg(F.sum(x).alias(x))
    if not zero_fill:
        return long
    long = cut(long)
    known = long.filter(F.col(taxon).isNotNull())
    if taxa is not None:
        names = df.sparkSession.createDataFrame([(t,) for t in taxa], f"`{taxon}` string")
    else:
        names = known.select(taxon).distinct()
    grid = expand_tables(long.select(unit).distinct(), names)
    cells = known.select(F.col(unit).alias("__unit"), F.col(taxon).alias("__taxon"), F.col(x).alias("__x"))
    match = F.col(unit).eqNullSafe(F.col("__unit")) & (F.col(taxon) == F.col("__taxon"))
    return grid.join(cells, match, "left").select(unit, taxon, F.coalesce("__x", F.lit(0.0)).alias(x))


def expand_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of one table with every row of another.

    The right rows are dealt into as many buckets as the cluster has cores, and each left row visits every bucket once, so the product
    is built by an ordinary hash join over all cores instead of one task holding a whole table.
    """
    buckets = max(1, left.sparkSession.sparkContext.defaultParallelism)
    values = right.withColumn("__bucket", F.pmod(F.xxhash64(*right.columns), F.lit(buckets)).cast("int"))
    visits = left.withColumn("__bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return visits.join(values, "__bucket").drop("__bucket")


def stack(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables, matched by column name."""
    return reduce(DataFrame.unionByName, dfs)


def sort_columns(df: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """Columns in name order, after the ones named in `first`."""
    rest = sorted(c for c in df.columns if c not in set(first))
    return df.select([F.col(f"`{c}`") for c in [*first, *rest]])


def arrange(df: DataFrame, *cols: str) -> DataFrame:
    """Sort ascending with NULL last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def balanced(df: DataFrame, strata: Sequence[str], across: str) -> DataFrame:
    """Keep the strata in which every observed value of `across` occurs.

    One distinct pass and a count per stratum replace the product of all key values. The kept strata are
    written first, so that their real size decides how they are joined.
    """
    seen = cut(df.select(*strata, across).distinct())
    needed = seen.select(across).distinct().agg(F.count(F.lit(1))).scalar()
    full = seen.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == needed).drop("__n")
    full = cut(full)
    marked = full.withColumnsRenamed({s: f"__{s}" for s in strata})
    match = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"__{s}")) for s in strata])
    return df.join(marked, match, "left_semi")
