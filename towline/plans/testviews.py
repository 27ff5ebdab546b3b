"""Survey-shaped views of the benchmark tables, each as a DataFrame and as the same SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cpue
from ..operators.aggregate import slides_to_cpue
from ..session import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
TASK_ROWS = 1 << 16  # raw lines of one task, at most four times as many in small tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station with site, region, distance and position."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("s_suppkey").alias("station"),
            F.col("n_name").alias("site"),
            F.col("r_name").alias("region"),
            F.col("s_acctbal").alias("ggdist"),
            (F.lit(37.8) + F.pmod(F.col("s_suppkey"), F.lit(50)) / F.lit(100.0)).alias("lat"),
            (F.lit(-122.5) + F.pmod(F.col("s_suppkey"), F.lit(97)) / F.lit(100.0)).alias("lon"),
        )
    )


STATIONS_SQL = """stations AS (
  SELECT s_suppkey AS station, n_name AS site, r_name AS region, s_acctbal AS ggdist,
         37.8 + (s_suppkey % 50) / 100.0 AS lat, -122.5 + (s_suppkey % 97) / 100.0 AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def _by_sample(lines: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and their samples, laid out alike, in as many tasks as the number of lines needs.

    A stated number is not merged by adaptive execution, whose tasks are bounded by compressed bytes and hold millions of lines. Joins and
    groupings by sample then need no shuffle of their own. A table of few lines is dealt out to all cores.
    """
    tasks = math.ceil(lines.count() / TASK_ROWS)
    if tasks <= 4 * lines.sparkSession.sparkContext.defaultParallelism:
        return spread(lines), orders
    return lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw count lines with sample, station and taxon attributes."""
    lines, orders = _by_sample(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    # Every other side joined is a plain scan, so its real size decides between broadcast and shuffle. Orders come
    # first, while lines are laid out by sample, and parts last: nothing downstream groups by part, so a later
    # grouping combines before it shuffles and does not inherit the layout of a skewed join.
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(supplier, lines.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .join(part, lines.l_partkey == part.p_partkey)
        .select(
            F.col("l_orderkey").alias("sample_id"),
            F.col("s_suppkey").alias("station"),
            F.col("n_name").alias("site"),
            F.col("r_name").alias("region"),
            F.col("s_acctbal").alias("ggdist"),
            (F.lit(37.8) + F.pmod(F.col("s_suppkey"), F.lit(50)) / F.lit(100.0)).alias("lat"),
            (F.lit(-122.5) + F.pmod(F.col("s_suppkey"), F.lit(97)) / F.lit(100.0)).alias("lon"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.month("o_orderdate").alias("month"),
            F.year("o_orderdate").alias("year"),
            F.col("o_orderpriority").alias("survey"),
            (F.round(F.col("l_tax") * 100).cast("int") + 1).alias("dilution"),
            (F.col("o_totalprice") / 10000).alias("volume"),
            F.col("p_brand").alias("taxon"),
            F.col("p_type").alias("tax3"),
            F.col("p_size").alias("size"),
            F.col("l_returnflag").alias("lifestage"),
            F.col("l_linenumber").alias("cell_number"),
            F.col("l_quantity").alias("n_count"),
            F.round(F.col("l_discount") * 350, 2).alias("sal"),
            F.col("p_retailprice").alias("biomass"),
            F.col("l_partkey").alias("part_id"),
        )
    )


RAW_SQL = STATIONS_SQL + """, raw AS (
  SELECT l_orderkey AS sample_id, station, site, region, ggdist, lat, lon,
         CAST(o_orderdate AS DATE) AS "date",
         CAST(month(o_orderdate) AS INTEGER) AS "month", CAST(year(o_orderdate) AS INTEGER) AS "year",
         o_orderpriority AS survey, CAST(round(l_tax * 100) AS INTEGER) + 1 AS dilution,
         o_totalprice / 10000 AS volume, p_brand AS taxon, p_type AS tax3, p_size AS size,
         l_returnflag AS lifestage, l_linenumber AS cell_number, l_quantity AS n_count,
         round(l_discount * 350, 2) AS sal, p_retailprice AS biomass, l_partkey AS part_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN stations ON l_suppkey = station
)"""

CATCH_KEYS = ["sample_id", "station", "site", "region", "survey", "ggdist", "date", "month", "year",
              "dilution", "volume", "taxon", "lifestage"]


def catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long catch: one row per sample, station, taxon and life stage, from the raw lines."""
    return slides_to_cpue(raw(spark, sf_dir), keys=CATCH_KEYS)


CATCH_SQL = RAW_SQL + """, by_taxon AS (
  SELECT sample_id, station, site, region, survey, ggdist, "date", "month", "year", dilution, volume, taxon,
         lifestage, sum(n_count) AS tot_count
  FROM raw GROUP BY ALL
), effort AS (
  SELECT sample_id, max(cell_number) AS tot_cells, sum(n_count) AS tot_count_all FROM raw GROUP BY sample_id
), catch AS (
  SELECT by_taxon.*, tot_cells, tot_count_all, tot_count / tot_cells * dilution / volume AS cpue
  FROM by_taxon JOIN effort USING (sample_id)
)"""


def catch_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catch lines with their environment, one row per raw line."""
    return raw(spark, sf_dir).withColumn("cpue", cpue("n_count", "cell_number", "dilution", "volume"))


CATCH_ENV_SQL = RAW_SQL + """, catch_env AS (
  SELECT *, n_count / cell_number * dilution / volume AS cpue FROM raw
)"""


def community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by taxa in long form: counts per station and taxon."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .groupBy(F.col("l_suppkey").alias("unit"), F.col("p_brand").alias("taxon"))
        .agg(F.sum("l_quantity").alias("x"))
    )


COMMUNITY_SQL = """community AS (
  SELECT l_suppkey AS unit, p_brand AS taxon, sum(l_quantity) AS x
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
)"""


def unit_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sampling unit: region, site within region, distance and a two-valued factor."""
    return stations(spark, sf_dir).select(
        F.col("station").alias("unit"), "region", "site", "ggdist",
        F.when(F.col("ggdist") > 5000, F.lit("far")).otherwise(F.lit("near")).alias("reach"),
    )


UNIT_ENV_SQL = STATIONS_SQL + """, env AS (
  SELECT station AS unit, region, site, ggdist, CASE WHEN ggdist > 5000 THEN 'far' ELSE 'near' END AS reach
  FROM stations
)"""

# Pairwise Bray-Curtis over the units, in SQL: the full matrix of units and taxa.
PAIRS_SQL = COMMUNITY_SQL + """, grid AS (
  SELECT u.unit, t.taxon, coalesce(c.x, 0) AS x
  FROM (SELECT DISTINCT unit FROM community) u CROSS JOIN (SELECT DISTINCT taxon FROM community) t
       LEFT JOIN community c ON c.unit = u.unit AND c.taxon = t.taxon
), pairs AS (
  SELECT a.unit AS i, b.unit AS j, sum(abs(a.x - b.x)) / sum(a.x + b.x) AS d
  FROM grid a JOIN grid b ON a.taxon = b.taxon AND a.unit < b.unit GROUP BY 1, 2
)"""


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coordinates per unit, standing for an ordination result."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("unit"),
        (F.col("s_acctbal") / 1000).alias("axis1"),
        F.pmod(F.col("s_suppkey"), F.lit(17)).cast("double").alias("axis2"),
    )


COORDS_SQL = """coords AS (
  SELECT s_suppkey AS unit, s_acctbal / 1000 AS axis1, CAST(s_suppkey % 17 AS DOUBLE) AS axis2 FROM supplier
)"""


def draws(spark: SparkSession, sf_dir: str, chains: int = 4) -> DataFrame:
    """Posterior-style draws: some chains per parameter, values of both signs."""
    return table(spark, sf_dir, "events").select(
        F.pmod(F.col("event_id"), F.lit(chains)).alias("chain"),
        F.floor(F.col("event_id") / chains).alias("iter"),
        F.col("event_type").alias("param"),
        (F.col("value") - 35).alias("value"),
    )


DRAWS_SQL = """draws AS (
  SELECT event_id % 4 AS chain, CAST(floor(event_id / 4) AS BIGINT) AS iter, event_type AS param,
         value - 35 AS value
  FROM events
)"""
