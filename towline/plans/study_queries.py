"""Queries that run the long-term and spring studies over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paste
from ..operators import permanova as pm
from ..operators import regression as reg
from ..operators.aggregate import cascade_mean, mean_sd_se
from ..operators.reshape import community_matrix
from . import studies
from . import testviews as tv
from .fixed import SALINITY_BREAKS
from .registry import query
from .tabular_queries import _BOX_CASE, _SEASON_CASE, _cut_case, r


def _long_term(spark, sf):
    catch = tv.catch_env(spark, sf).drop("region", "tax3").withColumnRenamed("taxon", "taxname")
    # The two reduced forms of a taxon name come from a crosswalk with one row per name.
    names = tv.table(spark, sf, "part").select(F.col("p_brand").alias("taxname")).distinct()
    taxa = names.select("taxname", F.substring("taxname", 1, 7).alias("tax2"), F.substring("taxname", 7, 1).alias("tax3"))
    return studies.long_term_catch(catch, taxa)


_LONG_TERM_SQL = tv.CATCH_ENV_SQL + f""", long_term AS (
  SELECT sample_id, station, month, year, volume, sal, cpue, substr(taxon, 1, 7) AS tax2, substr(taxon, 7, 1) AS tax3,
         {_SEASON_CASE} AS season, {_BOX_CASE} AS box
  FROM catch_env WHERE month > 2
)"""


@query("long_term_seasonal_means", f"""WITH {_LONG_TERM_SQL}
SELECT season, year, tax2, tax3, box AS region, round(avg(cpue), 6) AS cpue, round(avg(sal), 6) AS sal FROM long_term GROUP BY ALL""")
def long_term_seasonal_means(spark, sf):
    return studies.seasonal_means(_long_term(spark, sf)).withColumns({"cpue": r("cpue"), "sal": r("sal")})


@query("long_term_salinity_composition", f"""WITH {_LONG_TERM_SQL}, m AS (
  SELECT season, year, tax2, tax3, box AS region, avg(cpue) AS cpue, avg(sal) AS sal FROM long_term GROUP BY ALL
), b AS (SELECT season, tax2, tax3, {_cut_case('sal', SALINITY_BREAKS)} AS salbin, region, avg(cpue) AS cpue FROM m GROUP BY ALL),
t AS (SELECT season, region, salbin, tax2, sum(cpue) AS total FROM b GROUP BY ALL)
SELECT season, region, salbin, tax2, round(total, 6) AS total, round(total / sum(total) OVER (PARTITION BY season, region, salbin), 6) AS share FROM t""")
def long_term_salinity_composition(spark, sf):
    shares = studies.salinity_composition(studies.seasonal_means(_long_term(spark, sf)))
    return shares.withColumns({"total": r("total"), "share": r("share")})


_MONTHLY_SQL = _LONG_TERM_SQL + """, sample_totals AS (
  SELECT sample_id, station, volume, month, year, box, season, sal, tax2, sum(cpue) AS cpue FROM long_term GROUP BY ALL
), monthly AS (
  SELECT month, year, box AS region, season, tax2, avg(cpue) AS cpue, avg(sal) AS sal FROM sample_totals GROUP BY month, year, box, season, tax2
)"""


@query("long_term_monthly_community", f"""WITH {_MONTHLY_SQL}
SELECT month, year, region, season, tax2, round(cpue, 6) AS cpue, round(sal, 6) AS sal FROM monthly""")
def long_term_monthly_community(spark, sf):
    monthly = studies.monthly_community(_long_term(spark, sf), ["sample_id", "station", "volume"])
    return monthly.withColumns({"cpue": r("cpue"), "sal": r("sal")})


_TAXA2 = [f"Brand#{k}" for k in range(1, 10)]
_TAXA2_SQL = ", ".join(f"round(sum(CASE WHEN tax2 = '{t}' THEN cpue END), 6) AS \"{t}\"" for t in _TAXA2)


@query("long_term_monthly_matrix_literal", f"""WITH {_MONTHLY_SQL}
SELECT month, year, region, season, round(sal, 9) AS sal, {_TAXA2_SQL} FROM monthly GROUP BY month, year, region, season, round(sal, 9)""")
def long_term_monthly_matrix_literal(spark, sf):
    # Mean salinity is one of the identifying columns here, so taxa with different means get rows of their own.
    monthly = studies.monthly_community(_long_term(spark, sf), ["sample_id", "station", "volume"])
    matrix = community_matrix(monthly.withColumn("sal", r("sal", 9)), ["month", "year", "region", "season", "sal"], "tax2", "cpue", _TAXA2, fill=None)
    return matrix.withColumns({c: r(f"`{c}`") for c in _TAXA2})


def _monthly_units(spark, sf):
    """Month, year and region as the sampling unit, taxa as the community."""
    monthly = studies.monthly_community(
        _long_term(spark, sf).withColumn("tax2", F.col("taxname")), ["sample_id", "station", "volume"]
    ).filter("region IS NOT NULL")
    return monthly.withColumn("unit", paste("region", "year", "month"))


@query("long_term_permanova")
def long_term_permanova(spark, sf):
    monthly = _monthly_units(spark, sf)
    env = monthly.groupBy("unit", "region", "season", "year").agg(F.avg("sal").alias("sal"))
    return pm.permanova(monthly, env, ["region", "season", "year"], permutations=999, seed=11, x="cpue", taxon="tax2")


@query("spring_site_means", f"""WITH {tv.CATCH_ENV_SQL}, s AS (SELECT sample_id, site, region, survey, year, sum(cpue) AS cpue FROM catch_env GROUP BY ALL),
m AS (SELECT site, region, survey, year, avg(cpue) AS m FROM s GROUP BY ALL)
SELECT region, survey, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(*) AS n, round(stddev_samp(m) / count(*), 9) AS se FROM m GROUP BY 1, 2""")
def spring_site_means(spark, sf):
    samples = tv.catch_env(spark, sf).groupBy("sample_id", "site", "region", "survey", "year").agg(F.sum("cpue").alias("cpue"))
    sites = cascade_mean(samples, [["site", "region", "survey", "year"]], "cpue", out="m")
    stats = mean_sd_se(sites, ["region", "survey"], "m", se_mode="n")
    return stats.withColumns({"mean": r("mean"), "sd": r("sd"), "se": r("se", 9)})


@query("long_term_source_month_model", f"""WITH {tv.CATCH_ENV_SQL}, s AS (
  SELECT survey, month, year, sample_id, sum(cpue) AS cpue FROM catch_env GROUP BY ALL
), y AS (SELECT survey, month, ln(cpue) AS y FROM s WHERE cpue > 0 AND survey IS NOT NULL AND month IS NOT NULL), c AS (
  SELECT y, y - avg(y) OVER (PARTITION BY survey, month) AS e, y - avg(y) OVER () AS d FROM y
) SELECT count(*) AS n, (SELECT count(*) FROM s) - count(*) AS n_dropped, count(*) - (SELECT count(*) FROM (SELECT DISTINCT survey, month FROM y)) AS df_residual,
round(sqrt(sum(e * e) / (count(*) - (SELECT count(*) FROM (SELECT DISTINCT survey, month FROM y)))), 6) AS sigma, round(1 - sum(e * e) / sum(d * d), 6) AS r2 FROM c""")
def long_term_source_month_model(spark, sf):
    # Month is a factor, so the model has a mean for each cell of survey and month.
    samples = tv.catch_env(spark, sf).groupBy("survey", "month", "year", "sample_id").agg(F.sum("cpue").alias("cpue"))
    samples = samples.withColumn("month", F.col("month").cast("string"))
    statistics = reg.fit_statistics(spark, reg.ols(samples, F.ln("cpue"), ["survey*month"]))
    return statistics.withColumns({c: r(c) for c in ("sigma", "r2")})
