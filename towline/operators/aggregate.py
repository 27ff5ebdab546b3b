"""Catch aggregation: effort, totals, means at several levels, shares, lumping, biomass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cpue, mean_of, n_distinct, sum_of
from ..functions import cut as bins
from ..session import cut


def slides_to_cpue(
    counts: DataFrame,
    sample: str = "sample_id",
    keys: Sequence[str] = ("station", "date", "sample_id", "dilution", "taxon", "volume"),
    cell: str = "cell_number",
    count: str = "n_count",
    dilution: str = "dilution",
    volume: str = "volume",
) -> DataFrame:
    """Slide counts to catch per unit effort, one row per sample and taxon.

    Raw lines are reduced once by `keys`; the sample's effort (highest cell number) and total count
    are then taken over the reduced rows, of which a sample has no more than it has taxa.
    """
    if sample not in keys:
        raise ValueError("keys must contain the sample")
    by_taxon = counts.groupBy(*keys).agg(
        sum_of(count, skip_null=False).alias("tot_count"), F.max(cell).alias("__cells")
    )
    per_sample = Window.partitionBy(sample)
    effort = by_taxon.withColumns({
        "tot_cells": F.max("__cells").over(per_sample),
        "__unknown": F.max(F.col("tot_count").isNull().cast("int")).over(per_sample),
        "__total": F.sum("tot_count").over(per_sample),
    })
    return effort.withColumns({
        "tot_count_all": F.when(F.col("__unknown") == 0, F.col("__total")),
        "cpue": cpue("tot_count", "tot_cells", dilution, volume),
    }).drop("__cells", "__unknown", "__total")


def n_samples(df: DataFrame, by: Sequence[str], id: str, out: str = "n") -> DataFrame:
    """Exact number of samples per group."""
    return df.groupBy(*by).agg(n_distinct(id).alias(out))


def mean_sd_se(df: DataFrame, by: Sequence[str], col: str, se_mode: str = "sqrt_n") -> DataFrame:
    """Mean, standard deviation, n and standard error; `se_mode='n'` divides by n instead of its root."""
    if se_mode not in ("sqrt_n", "n"):
        raise ValueError("se_mode is 'sqrt_n' or 'n'")
    stats = df.groupBy(*by).agg(
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"), F.count(F.lit(1)).alias("n")
    )
    size = F.col("n") if se_mode == "n" else F.sqrt("n")
    return stats.withColumn("se", F.col("sd") / size)


def mean_of_totals(
    df: DataFrame,
    sample_keys: Sequence[str],
    stratum_keys: Sequence[str],
    col: str,
    out: str = "mean",
    skip_null: bool = True,
    also_mean: Sequence[str] = (),
) -> DataFrame:
    """Sum within sample, then mean of the sample totals per stratum."""
    extra = [c for c in also_mean if c not in sample_keys]
    totals = df.groupBy(*sample_keys).agg(
        sum_of(col, skip_null).alias("__total"), *[F.avg(c).alias(c) for c in extra]
    )
    return totals.groupBy(*stratum_keys).agg(
        mean_of("__total", skip_null).alias(out), F.count(F.lit(1)).alias("n_totals"),
        *[F.avg(c).alias(f"mean_{c}") for c in also_mean],
    )


def cascade_mean(
    df: DataFrame, levels: Sequence[Sequence[str]], col: str, out: str = "mean", skip_null: bool = False
) -> DataFrame:
    """Mean of means over successive levels, each group of a level weighing the same."""
    table, current = df, col
    for keys in levels:
        table = table.groupBy(*keys).agg(mean_of(current, skip_null).alias(out))
        current = out
    return table


def share_of_total(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Total per category and its share of the grand total, the grand total being summed from the totals."""
    totals = df.groupBy(*by).agg(sum_of(col, skip_null=False).alias("total"), F.sum(col).alias("__known"))
    grand = totals.agg(F.sum("__known")).scalar()
    return totals.withColumn("share", F.try_divide(F.col("total"), grand)).drop("__known")


def lump_rare(
    df: DataFrame, category: str, col: str, threshold: float, other: str = "other", out: str = "lumped"
) -> DataFrame:
    """Rename categories whose share of the grand total is under a threshold.

    The shares are written first: with its real size known, a short list of categories is broadcast and
    the catch is not shuffled by category, where one common category would be one task.
    """
    shares = cut(share_of_total(df, [category], col).select(
        F.col(category).alias("__category"),
        F.when(F.col("share") < threshold, F.lit(other)).otherwise(F.col(category)).alias(out),
    ))
    return df.join(shares, F.col(category).eqNullSafe(F.col("__category")), "left").drop("__category")


def drop_zero_categories(df: DataFrame, category: str, col: str) -> DataFrame:
    """Remove categories whose total is zero or unknown; the kept ones are written first, as in `lump_rare`."""
    kept = df.groupBy(category).agg(sum_of(col, skip_null=False).alias("__total")).filter("__total != 0")
    return df.join(cut(kept.select(category)), category, "left_semi")


def env_table(df: DataFrame, keys: Sequence[str], col: str, out: str = "tot") -> DataFrame:
    """One row per sample with its environment columns and total catch."""
    return df.groupBy(*keys).agg(sum_of(col, skip_null=False).alias(out))


def to_biomass(
    catch: DataFrame, conversion: DataFrame, by: Sequence[str], factor: str, col: str = "cpue", out: str = "bpue"
) -> DataFrame:
    """Biomass per unit effort; rows without a conversion factor drop out, as in an inner join."""
    return catch.join(conversion.select(*by, factor), list(by), "inner").withColumn(out, F.col(col) * F.col(factor))


def composition(df: DataFrame, by: Sequence[str], category: str, col: str) -> DataFrame:
    """Share of each category within a cell: the numbers behind every filled bar."""
    totals = df.groupBy(*by, category).agg(F.sum(col).alias("total"))
    cell = Window.partitionBy(*by)
    return totals.withColumn("share", F.try_divide(F.col("total"), F.sum("total").over(cell)))


def stacked(df: DataFrame, by: Sequence[str], category: str, col: str) -> DataFrame:
    """Total of each category within a cell and the lower and upper edge of its bar segment."""
    totals = df.groupBy(*by, category).agg(F.sum(col).alias("total"))
    running = Window.partitionBy(*by).orderBy(category).rowsBetween(Window.unboundedPreceding, 0)
    top = totals.withColumn("upper", F.sum("total").over(running))
    return top.withColumn("lower", F.col("upper") - F.col("total"))


def relative_abundance(df: DataFrame, unit: str, taxon: str, x: str, out: str = "relative") -> DataFrame:
    """Each taxon's part of its unit's total; a unit without catch gives NULL."""
    long = df.groupBy(unit, taxon).agg(F.sum(x).alias(x))
    return long.withColumn(out, F.try_divide(F.col(x), F.sum(x).over(Window.partitionBy(unit))))


def histogram(df: DataFrame, col: str, breaks: Sequence[float], log_scale: bool = False) -> DataFrame:
    """Rows per right-closed bin; values outside all bins are counted under a NULL bin."""
    value = F.ln(col) if log_scale else F.col(col)
    return df.select(bins(value, breaks).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
