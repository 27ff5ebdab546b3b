"""Queries for dissimilarity, group tests, ordination, regressions, taxa and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sum_of
from ..operators import dissimilarity as dis
from ..operators import draws as dr
from ..operators import ordination as ordi
from ..operators import permanova as pm
from ..operators import regression as reg
from ..operators import scaling, surface
from ..operators import taxa as tx
from ..operators.design import categorical, design_rows, numeric
from ..operators.simper import simper
from . import testviews as tv
from .registry import query
from .tabular_queries import r

# ---------------------------------------------------------------- dissimilarity


@query("bray_curtis_pairs", f"WITH {tv.PAIRS_SQL} SELECT i, j, round(d, 6) AS d FROM pairs")
def bray_curtis_pairs(spark, sf):
    return dis.bray_curtis(tv.community(spark, sf)).withColumn("d", r("d"))


@query("double_standardised", f"""WITH {tv.COMMUNITY_SQL}, s AS (SELECT unit, taxon, sqrt(x) / max(sqrt(x)) OVER (PARTITION BY taxon) AS x FROM community)
SELECT unit, taxon, round(x / sum(x) OVER (PARTITION BY unit), 6) AS x FROM s""")
def double_standardised(spark, sf):
    return dis.wisconsin(tv.community(spark, sf)).withColumn("x", r("x"))


def _within(column: str) -> str:
    """Within-group sum of squared dissimilarity for a grouping of the units."""
    return f"""(SELECT sum(ss / n) FROM (
      SELECT a.{column} AS g, sum(d * d) AS ss FROM pairs JOIN env a ON a.unit = i JOIN env b ON b.unit = j
      WHERE a.{column} = b.{column} GROUP BY 1) JOIN (SELECT {column} AS g, count(*) AS n FROM env GROUP BY 1) USING (g))"""


_TOTAL = "(SELECT sum(d * d) / (SELECT count(*) FROM env) FROM pairs)"
_TESTED_SQL = f"WITH {tv.UNIT_ENV_SQL}, {tv.PAIRS_SQL}"


@query("permanova_oneway", f"""{_TESTED_SQL}, s AS (
  SELECT {_TOTAL} AS ss_total, {_within('region')} AS ss_residual, (SELECT count(*) FROM env) AS n, (SELECT count(DISTINCT region) FROM env) AS k
) SELECT 'region' AS term, k - 1 AS df, n - k AS df_residual, round(ss_total, 6) AS ss_total, round(ss_residual, 6) AS ss_residual,
round(ss_total - ss_residual, 6) AS ss, round(((ss_total - ss_residual) / (k - 1)) / (ss_residual / (n - k)), 6) AS f,
round((ss_total - ss_residual) / ss_total, 6) AS r2 FROM s""")
def permanova_oneway(spark, sf):
    result = pm.permanova_oneway(tv.community(spark, sf), tv.unit_env(spark, sf), "region")
    return result.withColumns({c: r(c) for c in ("ss_total", "ss_residual", "ss", "f", "r2")})


def _rounded_test(result):
    return result.select("term", "df", *[r(c).alias(c) for c in ("ss", "ms", "f", "r2")])


_TEST_ROWS = """SELECT term, df, round(ss, 6) AS ss, round(ss / df, 6) AS ms, round((ss / df) / (residual / df_residual), 6) AS f, round(ss / total, 6) AS r2 FROM terms
UNION ALL SELECT 'residual', df_residual, round(residual, 6), round(residual / df_residual, 6), NULL, round(residual / total, 6) FROM s
UNION ALL SELECT 'total', n - 1, round(total, 6), NULL, NULL, 1.0 FROM s"""


@query("permanova_nested", f"""{_TESTED_SQL}, b AS (
  SELECT {_TOTAL} AS total, {_within('region')} AS w_region, {_within('site')} AS residual, (SELECT count(*) FROM env) AS n,
         (SELECT count(DISTINCT region) FROM env) AS k_region, (SELECT count(DISTINCT site) FROM env) AS k_site
), s AS (SELECT *, n - k_site AS df_residual FROM b), terms AS (
  SELECT 'region' AS term, k_region - 1 AS df, total - w_region AS ss, residual, df_residual, total FROM s
  UNION ALL SELECT 'site', k_site - k_region, w_region - residual, residual, df_residual, total FROM s
) {_TEST_ROWS}""")
def permanova_nested(spark, sf):
    return _rounded_test(pm.permanova(tv.community(spark, sf), tv.unit_env(spark, sf), ["region", "site"], permutations=0))


@query("permanova_covariate", f"""{_TESTED_SQL}, q AS (
  SELECT unit, (ggdist - avg(ggdist) OVER ()) / sqrt(var_pop(ggdist) OVER () * count(*) OVER ()) AS q FROM env
), b AS (SELECT {_TOTAL} AS total, (SELECT -sum(d * d * a.q * b.q) FROM pairs JOIN q a ON a.unit = i JOIN q b ON b.unit = j) AS ss,
  (SELECT count(*) FROM env) AS n
), s AS (SELECT *, total - ss AS residual, n - 2 AS df_residual FROM b), terms AS (SELECT 'ggdist' AS term, 1 AS df, * FROM s) {_TEST_ROWS}""")
def permanova_covariate(spark, sf):
    return _rounded_test(pm.permanova(tv.community(spark, sf), tv.unit_env(spark, sf), ["ggdist"], permutations=0))


@query("permanova_interaction", f"""WITH {tv.STATIONS_SQL}, env AS (
  SELECT station AS unit, region, reach, region || reach AS cell
  FROM (SELECT *, CASE WHEN ggdist > 5000 THEN 'far' ELSE 'near' END AS reach FROM stations)
), {tv.PAIRS_SQL}, c AS (
  SELECT unit, CASE WHEN reach = 'near' THEN 1.0 ELSE 0.0 END - avg(CASE WHEN reach = 'near' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY region) AS v FROM env
), q AS (SELECT unit, v / sqrt(sum(v * v) OVER ()) AS q FROM c), b AS (
  SELECT {_TOTAL} AS total, {_within('region')} AS w_region, {_within('cell')} AS residual, (SELECT count(*) FROM env) AS n,
         (SELECT -sum(d * d * a.q * b.q) FROM pairs JOIN q a ON a.unit = i JOIN q b ON b.unit = j) AS ss_reach,
         (SELECT count(DISTINCT region) FROM env) AS k_region, (SELECT count(DISTINCT cell) FROM env) AS k_cell
), s AS (SELECT *, n - k_cell AS df_residual FROM b), terms AS (
  SELECT 'region' AS term, k_region - 1 AS df, total - w_region AS ss, residual, df_residual, total FROM s
  UNION ALL SELECT 'reach', 1, ss_reach, residual, df_residual, total FROM s
  UNION ALL SELECT 'region:reach', k_cell - k_region - 1, w_region - residual - ss_reach, residual, df_residual, total FROM s
) {_TEST_ROWS}""")
def permanova_interaction(spark, sf):
    return _rounded_test(pm.permanova(tv.community(spark, sf), tv.unit_env(spark, sf), ["region*reach"], permutations=0))


@query("permanova_permutations", f"""WITH RECURSIVE {tv.UNIT_ENV_SQL}, {tv.PAIRS_SQL}, {pm.permutation_sql("env", 7, 999)},
c AS (SELECT unit, region, ggdist - avg(ggdist) OVER (PARTITION BY region) AS v FROM env), q AS (SELECT unit, region, v / sqrt(sum(v * v) OVER ()) AS q FROM c),
labelled AS (SELECT perm, a.unit, t.region, t.q FROM (SELECT * FROM sent UNION ALL SELECT 0, pos, pos FROM placed) s JOIN placed a ON a.pos = s.pos JOIN placed b ON b.pos = s.too JOIN q t ON t.unit = b.unit),
sizes AS (SELECT region, count(*) AS size FROM env GROUP BY 1),
sums AS (SELECT a.perm, sum(CASE WHEN a.region = b.region THEN d * d / size ELSE 0 END) AS within, -sum(d * d * a.q * b.q) AS covariate
  FROM pairs JOIN labelled a ON a.unit = i JOIN labelled b ON b.unit = j AND b.perm = a.perm JOIN sizes ON sizes.region = a.region GROUP BY 1),
b AS (SELECT {_TOTAL} AS total, (SELECT count(*) FROM env) AS n, (SELECT count(*) FROM sizes) AS k),
f AS (SELECT perm, total, n, k, total - within AS ss1, covariate AS ss2, within - covariate AS residual, n - k - 1 AS df_residual FROM sums, b),
ratio AS (SELECT *, (ss1 / (k - 1)) / (residual / df_residual) AS f1, ss2 / (residual / df_residual) AS f2 FROM f),
s AS (SELECT * FROM ratio WHERE perm = 0),
p AS (SELECT (1 + count(*) FILTER (r.f1 >= s.f1 * (1 - 1e-12))) / 1000 AS p1, (1 + count(*) FILTER (r.f2 >= s.f2 * (1 - 1e-12))) / 1000 AS p2 FROM ratio r, s WHERE r.perm > 0)
SELECT 'region' AS term, k - 1 AS df, round(ss1, 6) AS ss, round(ss1 / (k - 1), 6) AS ms, round(f1, 6) AS f, round(ss1 / total, 6) AS r2, p1 AS p FROM s, p
UNION ALL SELECT 'ggdist', 1, round(ss2, 6), round(ss2, 6), round(f2, 6), round(ss2 / total, 6), p2 FROM s, p
UNION ALL SELECT 'residual', df_residual, round(residual, 6), round(residual / df_residual, 6), NULL, round(residual / total, 6), NULL FROM s
UNION ALL SELECT 'total', n - 1, round(total, 6), NULL, NULL, 1.0, NULL FROM s""")
def permanova_permutations(spark, sf):
    result = pm.permanova(tv.community(spark, sf), tv.unit_env(spark, sf), ["region", "ggdist"], permutations=999, seed=7)
    return result.withColumns({c: r(c) for c in ("ss", "ms", "f", "r2")})


@query("explained_variance", f"""{_TESTED_SQL}, s AS (SELECT {_TOTAL} AS ss_total, {_within('region')} AS ss_residual)
SELECT 'region' AS predictor, round((ss_total - ss_residual) / ss_total, 6) AS r2 FROM s
UNION ALL SELECT 'residual', round(ss_residual / ss_total, 6) FROM s""")
def explained_variance(spark, sf):
    result = pm.permanova(tv.community(spark, sf), tv.unit_env(spark, sf), ["region"], permutations=0)
    return pm.explained(result).withColumn("r2", r("r2"))


@query("simper", f"""{_TESTED_SQL}, t AS (SELECT unit, sum(x) AS total FROM community GROUP BY 1), c AS (
  SELECT ea.region AS g1, eb.region AS g2, a.taxon, abs(a.x - b.x) / (ta.total + tb.total) AS c
  FROM grid a JOIN grid b ON a.taxon = b.taxon JOIN env ea ON ea.unit = a.unit JOIN env eb ON eb.unit = b.unit
       JOIN t ta ON ta.unit = a.unit JOIN t tb ON tb.unit = b.unit
  WHERE ea.region < eb.region
), m AS (SELECT region, taxon, avg(x) AS m FROM grid JOIN env USING (unit) GROUP BY ALL), s AS (
  SELECT g1, g2, taxon, avg(c) AS average, stddev_samp(c) AS sd FROM c GROUP BY ALL
) SELECT g1, g2, s.taxon, round(average, 6) AS average, round(sd, 6) AS sd, round(average / sd, 4) AS ratio, round(m1.m, 4) AS mean1, round(m2.m, 4) AS mean2,
round(sum(average) OVER (PARTITION BY g1, g2 ORDER BY average DESC, s.taxon) / sum(average) OVER (PARTITION BY g1, g2), 6) AS cumulative
FROM s JOIN m m1 ON m1.region = g1 AND m1.taxon = s.taxon JOIN m m2 ON m2.region = g2 AND m2.taxon = s.taxon""")
def simper_query(spark, sf):
    table = simper(tv.community(spark, sf), tv.unit_env(spark, sf), "region")
    return table.withColumns({"average": r("average"), "sd": r("sd"), "ratio": r("ratio", 4), "mean1": r("mean1", 4),
                              "mean2": r("mean2", 4), "cumulative": r("cumulative")})


@query("dissimilarity_summary", f"""{_TESTED_SQL}
SELECT least(a.region, b.region) AS g1, greatest(a.region, b.region) AS g2, count(*) AS n_pairs, round(avg(d), 6) AS mean_d
FROM pairs JOIN env a ON a.unit = i JOIN env b ON b.unit = j GROUP BY 1, 2""")
def dissimilarity_summary(spark, sf):
    summary = dis.dissimilarity_summary(tv.community(spark, sf), tv.unit_env(spark, sf), "region")
    return summary.withColumn("mean_d", r("mean_d"))


# ---------------------------------------------------------------- ordination


@query("nmds")
def nmds(spark, sf):
    found = scaling.nmds(tv.community(spark, sf), starts=8, max_starts=16, seed=3)
    return found.coords.withColumns({"stress": F.lit(found.stress), "converged": F.lit(found.converged), "found_twice": F.lit(found.found_twice)})


@query("nmds_by_region")
def nmds_by_region(spark, sf):
    return scaling.nmds_by(tv.community(spark, sf), tv.unit_env(spark, sf), "region", starts=8, max_starts=16, seed=3)


@query("taxon_scores", f"""WITH {tv.COMMUNITY_SQL}, {tv.COORDS_SQL}
SELECT taxon, round(sum(x * axis1) / sum(x), 6) AS axis1, round(sum(x * axis2) / sum(x), 6) AS axis2 FROM community JOIN coords USING (unit) GROUP BY 1""")
def taxon_scores(spark, sf):
    scores = ordi.taxon_scores(tv.coords(spark, sf), tv.community(spark, sf))
    return scores.withColumns({"axis1": r("axis1"), "axis2": r("axis2")})


@query("group_ellipse", f"""WITH {tv.UNIT_ENV_SQL}, {tv.COORDS_SQL}, s AS (
  SELECT region, count(*) AS n, avg(axis1) AS center1, avg(axis2) AS center2, var_samp(axis1) AS v11, var_samp(axis2) AS v22, covar_samp(axis1, axis2) AS v12
  FROM coords JOIN env USING (unit) GROUP BY 1
), e AS (SELECT *, (v11 + v22) / 2 AS middle, sqrt(((v11 - v22) / 2) ** 2 + v12 ** 2) AS half FROM s)
SELECT region, n, round(center1, 6) AS center1, round(center2, 6) AS center2, round(sqrt(-2 * ln(0.05)) * sqrt(middle + half), 6) AS major,
round(sqrt(-2 * ln(0.05)) * sqrt(greatest(middle - half, 0)), 6) AS minor, round(atan2(2 * v12, v11 - v22) / 2, 6) AS angle FROM e""")
def group_ellipse(spark, sf):
    ellipse = ordi.group_ellipse(tv.coords(spark, sf), tv.unit_env(spark, sf), "region")
    return ellipse.withColumns({c: r(c) for c in ("center1", "center2", "major", "minor", "angle")})


@query("group_spider", f"""WITH {tv.UNIT_ENV_SQL}, {tv.COORDS_SQL}
SELECT unit, region, axis1, axis2, round(avg(axis1) OVER (PARTITION BY region), 6) AS center1, round(avg(axis2) OVER (PARTITION BY region), 6) AS center2
FROM coords JOIN env USING (unit)""")
def group_spider(spark, sf):
    spider = ordi.group_spider(tv.coords(spark, sf), tv.unit_env(spark, sf), "region")
    return spider.withColumns({"center1": r("center1"), "center2": r("center2")})


@query("surface_grid", f"""WITH {tv.UNIT_ENV_SQL}, {tv.COORDS_SQL}, b AS (SELECT min(axis1) AS a0, max(axis1) AS a1, min(axis2) AS b0, max(axis2) AS b1 FROM coords)
SELECT CAST(least(floor((axis1 - a0) * 8 / (a1 - a0)), 7) AS INTEGER) AS gx, CAST(least(floor((axis2 - b0) * 6 / (b1 - b0)), 5) AS INTEGER) AS gy,
round(avg(lat), 6) AS mean, count(*) AS n FROM coords JOIN (SELECT station AS unit, lat FROM stations) USING (unit), b GROUP BY 1, 2""")
def surface_grid(spark, sf):
    env = tv.stations(spark, sf).select(F.col("station").alias("unit"), "lat")
    return ordi.surface_grid(tv.coords(spark, sf), env, "lat", nx=8, ny=6).withColumn("mean", r("mean"))


@query("smooth_surface")
def smooth_surface(spark, sf):
    env = tv.stations(spark, sf).select(F.col("station").alias("unit"), "lat")
    found = surface.smooth_surface(tv.coords(spark, sf), env, "lat")
    return found.grid.withColumns({"penalty": F.lit(found.penalty), "edf": F.lit(found.edf), "r2": F.lit(found.r2)})


# ---------------------------------------------------------------- regression


def _samples(spark, sf):
    """Total catch per sample with survey, half of the year and mean distance."""
    return tv.catch_env(spark, sf).groupBy("sample_id", "survey", "month").agg(
        sum_of("cpue", skip_null=True).alias("cpue"), F.avg("ggdist").alias("ggdist")
    ).withColumn("half", F.when(F.col("month") <= 6, F.lit("early")).otherwise(F.lit("late")))


_SAMPLES_SQL = tv.CATCH_ENV_SQL + """, samples AS (
  SELECT sample_id, survey, month, sum(cpue) AS cpue, avg(ggdist) AS ggdist, CASE WHEN month <= 6 THEN 'early' ELSE 'late' END AS half
  FROM catch_env GROUP BY sample_id, survey, month
), logged AS (SELECT *, ln(cpue) AS y FROM samples)"""


@query("design_rows", f"""WITH {tv.UNIT_ENV_SQL}
SELECT unit, 1.0 AS x0, CASE WHEN region = 'AMERICA' THEN 1.0 ELSE 0.0 END AS x1, CASE WHEN region = 'ASIA' THEN 1.0 ELSE 0.0 END AS x2,
CASE WHEN region = 'EUROPE' THEN 1.0 ELSE 0.0 END AS x3, CASE WHEN region = 'MIDDLE EAST' THEN 1.0 ELSE 0.0 END AS x4, ggdist AS x5,
CASE WHEN region = 'AMERICA' THEN ggdist ELSE 0.0 END AS x6, CASE WHEN region = 'ASIA' THEN ggdist ELSE 0.0 END AS x7,
CASE WHEN region = 'EUROPE' THEN ggdist ELSE 0.0 END AS x8, CASE WHEN region = 'MIDDLE EAST' THEN ggdist ELSE 0.0 END AS x9 FROM env""".replace("THEN 1.0 ELSE 0.0", "THEN 1::DOUBLE ELSE 0::DOUBLE").replace(" 1.0 AS x0", " 1::DOUBLE AS x0").replace("ELSE 0.0", "ELSE 0::DOUBLE"))
def design_rows_query(spark, sf):
    rows, names = design_rows(tv.unit_env(spark, sf), ["region*ggdist"], keep=["unit"])
    return rows.select("unit", *[F.get("x", F.lit(k)).alias(f"x{k}") for k in range(len(names))])


@query("linear_model", f"""WITH {_SAMPLES_SQL}, s AS (
  SELECT count(*) AS n, avg(ggdist) AS xm, var_pop(ggdist) * count(*) AS sxx, regr_slope(y, ggdist) AS b, regr_intercept(y, ggdist) AS a,
         regr_r2(y, ggdist) AS r2, var_pop(y) * count(*) AS syy FROM logged
), e AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM s)
SELECT '(intercept)' AS "column", round(a, 6) AS estimate, round(sqrt(s2 * (1.0 / n + xm * xm / sxx)), 6) AS se, round(a / sqrt(s2 * (1.0 / n + xm * xm / sxx)), 4) AS statistic FROM e
UNION ALL SELECT 'ggdist', round(b, 9), round(sqrt(s2 / sxx), 9), round(b / sqrt(s2 / sxx), 4) FROM e""")
def linear_model(spark, sf):
    table = reg.ols(_samples(spark, sf), F.ln("cpue"), ["ggdist"]).table(spark)
    digits = F.when(F.col("term") == "ggdist", 9).otherwise(6)
    return table.select(
        "column", F.when(digits == 9, F.round("estimate", 9)).otherwise(F.round("estimate", 6)).alias("estimate"),
        F.when(digits == 9, F.round("se", 9)).otherwise(F.round("se", 6)).alias("se"), r("statistic", 4).alias("statistic"),
    )


@query("linear_model_interaction", f"""WITH {_SAMPLES_SQL}, m AS (SELECT survey, half, avg(y) AS m FROM logged GROUP BY ALL),
w AS (SELECT survey, max(CASE WHEN half = 'early' THEN m END) AS e, max(CASE WHEN half = 'late' THEN m END) AS l FROM m GROUP BY 1),
base AS (SELECT e AS e1, l AS l1 FROM w ORDER BY survey LIMIT 1)
SELECT '(intercept)' AS "column", round(e1, 6) AS estimate FROM base
UNION ALL SELECT 'survey[' || survey || ']', round(e - e1, 6) FROM w, base WHERE survey <> '1-URGENT'
UNION ALL SELECT 'half[late]', round(l1 - e1, 6) FROM base
UNION ALL SELECT 'survey[' || survey || ']:half[late]', round(l - e - l1 + e1, 6) FROM w, base WHERE survey <> '1-URGENT'""")
def linear_model_interaction(spark, sf):
    table = reg.ols(_samples(spark, sf), F.ln("cpue"), ["survey*half"]).table(spark)
    return table.select("column", r("estimate").alias("estimate"))


@query("linear_model_aliased", f"""WITH {tv.CATCH_ENV_SQL}, l AS (SELECT station, region, site, ln(sum(cpue)) AS y FROM catch_env GROUP BY ALL),
s AS (SELECT site, any_value(region) AS region, avg(y) AS m, count(*) AS n, sum(y) AS t FROM l GROUP BY 1)
SELECT round(sum(y * y) - (SELECT sum(t * t / n) FROM s), 6) AS rss, count(*) - (SELECT count(*) FROM s) AS df_residual,
(SELECT count(*) - 1 + count(DISTINCT region) - 1 - (count(*) - 1) FROM s) AS n_aliased FROM l""")
def linear_model_aliased(spark, sf):
    stations = tv.catch_env(spark, sf).groupBy("station", "region", "site").agg(F.sum("cpue").alias("cpue"))
    fit = reg.ols(stations, F.ln("cpue"), ["region", "site"])
    aliased = len(fit.spec.columns) - len(fit.kept)
    row = [(round(float(fit.sigma2) * fit.df_residual, 6), fit.df_residual, aliased)]
    return spark.createDataFrame(row, "rss double, df_residual bigint, n_aliased bigint")


@query("poisson_model", f"""WITH {_SAMPLES_SQL}, m AS (SELECT survey, avg(round_even(cpue, 0)) AS m, sum(round_even(cpue, 0)) AS t FROM samples GROUP BY 1),
base AS (SELECT m AS m1, t AS t1 FROM m ORDER BY survey LIMIT 1)
SELECT '(intercept)' AS "column", round(ln(m1), 6) AS estimate, round(sqrt(1 / t1), 6) AS se FROM base
UNION ALL SELECT 'survey[' || survey || ']', round(ln(m) - ln(m1), 6), round(sqrt(1 / t + 1 / t1), 6) FROM m, base WHERE survey <> '1-URGENT'""")
def poisson_model(spark, sf):
    table = reg.glm_poisson(_samples(spark, sf), F.bround("cpue", 0), ["survey"]).table(spark)
    return table.select("column", r("estimate").alias("estimate"), r("se").alias("se"))


@query("negative_binomial_means", f"""WITH {_SAMPLES_SQL}, m AS (SELECT survey, avg(round_even(cpue, 0)) AS m FROM samples GROUP BY 1),
base AS (SELECT m AS m1 FROM m ORDER BY survey LIMIT 1)
SELECT '(intercept)' AS "column", round(ln(m1), 6) AS estimate FROM base
UNION ALL SELECT 'survey[' || survey || ']', round(ln(m) - ln(m1), 6) FROM m, base WHERE survey <> '1-URGENT'""")
def negative_binomial_means(spark, sf):
    table = reg.glm_negbin(_samples(spark, sf), F.bround("cpue", 0), ["survey"]).fit.table(spark)
    return table.select("column", r("estimate").alias("estimate"))


@query("negative_binomial_model")
def negative_binomial_model(spark, sf):
    terms = ["survey", numeric("month")]
    return reg.glm_negbin(_samples(spark, sf), F.bround("cpue", 0), terms).table(spark)


@query("random_intercept_model")
def random_intercept_model(spark, sf):
    lines = tv.catch_env(spark, sf).groupBy("sample_id", "site", "region", "year").agg(F.sum("cpue").alias("cpue"))
    return reg.lmm_intercept(lines, F.ln("cpue"), ["region", categorical("year")], "site").table(spark)


_ANCOVA_SQL = f"""WITH {_SAMPLES_SQL}, c AS (
  SELECT *, y - avg(y) OVER (PARTITION BY survey) AS yc, month - avg(month) OVER (PARTITION BY survey) AS xc,
         avg(y) OVER (PARTITION BY survey) AS ym, avg(month) OVER (PARTITION BY survey) AS xm, avg(month) OVER () AS xall FROM logged
), b AS (SELECT sum(xc * yc) / sum(xc * xc) AS b FROM c)"""


@query("partial_residuals", f"""{_ANCOVA_SQL}
SELECT sample_id, survey, round(ym - b * xm + b * xall, 6) AS effect, round(yc - b * xc, 6) AS residual,
round(ym - b * xm + b * xall + yc - b * xc, 6) AS partial_residual FROM c, b""")
def partial_residuals(spark, sf):
    samples = _samples(spark, sf)
    fit = reg.ols(samples, F.ln("cpue"), ["survey", numeric("month")])
    rows = reg.partial_residuals(samples, F.ln("cpue"), fit, "survey")
    return rows.select("sample_id", "survey", *[r(c).alias(c) for c in ("effect", "residual", "partial_residual")])


@query("term_effect", f"""{_ANCOVA_SQL}
SELECT survey AS level, round(any_value(ym - b * xm + b * xall), 6) AS fit FROM c, b GROUP BY 1""")
def term_effect(spark, sf):
    fit = reg.ols(_samples(spark, sf), F.ln("cpue"), ["survey", numeric("month")])
    return reg.term_effect(spark, fit, "survey").select("level", r("fit").alias("fit"))


@query("fit_diagnostics", f"""WITH {_SAMPLES_SQL}, s AS (
  SELECT count(*) AS n, avg(ggdist) AS xm, var_pop(ggdist) * count(*) AS sxx, regr_slope(y, ggdist) AS b, regr_intercept(y, ggdist) AS a,
         var_pop(y) * count(*) * (1 - regr_r2(y, ggdist)) / (count(*) - 2) AS s2 FROM logged
), d AS (SELECT sample_id, y, a + b * ggdist AS fitted, 1.0 / n + (ggdist - xm) * (ggdist - xm) / sxx AS h, s2 FROM logged, s)
SELECT sample_id, round(fitted, 6) AS fitted, round(y - fitted, 6) AS residual, round(h, 9) AS leverage,
round((y - fitted) / sqrt(s2 * (1 - h)), 6) AS std_residual FROM d""")
def fit_diagnostics(spark, sf):
    samples = _samples(spark, sf)
    fit = reg.ols(samples, F.ln("cpue"), ["ggdist"])
    rows = reg.diagnostics(samples, F.ln("cpue"), fit)
    return rows.select("sample_id", r("fitted").alias("fitted"), r("residual").alias("residual"),
                       r("leverage", 9).alias("leverage"), r("std_residual").alias("std_residual"))


# ---------------------------------------------------------------- taxa


_GRID_SQL = f"WITH {tv.UNIT_ENV_SQL}, {tv.PAIRS_SQL.split(', pairs AS')[0]}, g AS (SELECT grid.unit, taxon, x, ggdist, CAST(unit % 2 AS INTEGER) AS fold FROM grid JOIN env USING (unit))"


@query("taxa_regression", f"""{_GRID_SQL}
SELECT taxon, '(intercept)' AS "column", round(regr_intercept(x, ggdist), 6) AS estimate FROM g GROUP BY 1
UNION ALL SELECT taxon, 'ggdist', round(regr_slope(x, ggdist), 8) FROM g GROUP BY 1""")
def taxa_regression(spark, sf):
    table = tx.taxa_ols(tv.community(spark, sf), tv.unit_env(spark, sf), ["ggdist"])
    rounded = F.when(F.col("term") == "ggdist", F.round("estimate", 8)).otherwise(F.round("estimate", 6))
    return table.select("taxon", "column", rounded.alias("estimate"))


@query("fold_assignment", "SELECT s_suppkey, CAST(s_suppkey % 3 AS INTEGER) AS fold FROM supplier")
def fold_assignment(spark, sf):
    return tx.assign_folds(tv.table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 3)


_CROSS_SQL = f"""{_GRID_SQL}, c AS (
  SELECT taxon, 1 - fold AS fold, regr_slope(x, ggdist) AS b, regr_intercept(x, ggdist) AS a FROM g GROUP BY taxon, fold
), p AS (SELECT unit, taxon, fold, x AS observed, a + b * ggdist AS predicted FROM g JOIN c USING (taxon, fold))"""


@query("cross_prediction", f"""{_CROSS_SQL}
SELECT unit, taxon, fold, observed, round(predicted, 6) AS predicted FROM p""")
def cross_prediction(spark, sf):
    predicted = tx.cross_predict(tv.community(spark, sf), tv.unit_env(spark, sf), ["ggdist"], k=2)
    return predicted.withColumn("predicted", r("predicted"))


@query("fit_metrics", f"""{_CROSS_SQL}
SELECT taxon, round(sqrt(avg((observed - predicted) ** 2)), 6) AS rmse,
round(sign(corr(observed, predicted)) * corr(observed, predicted) ** 2, 6) AS r2, count(*) AS n FROM p GROUP BY 1""")
def fit_metrics(spark, sf):
    predicted = tx.cross_predict(tv.community(spark, sf), tv.unit_env(spark, sf), ["ggdist"], k=2)
    return tx.fit_metrics(predicted).withColumns({"rmse": r("rmse"), "r2": r("r2")})


@query("taxon_association", f"""{_GRID_SQL}, c AS (SELECT taxon, regr_slope(x, ggdist) AS b, regr_intercept(x, ggdist) AS a FROM g GROUP BY 1),
e AS (SELECT unit, taxon, x - a - b * ggdist AS v FROM g JOIN c USING (taxon)),
k AS (SELECT p.taxon AS a, q.taxon AS b, corr(p.v, q.v) AS r FROM e p JOIN e q ON p.unit = q.unit AND p.taxon <= q.taxon GROUP BY 1, 2)
SELECT a, b, round(r, 6) AS r, round(CASE WHEN abs(r) > 0.1 THEN r ELSE 0.0 END, 6) AS shown FROM k""")
def taxon_association(spark, sf):
    resid = tx.taxa_residuals(tv.community(spark, sf), tv.unit_env(spark, sf), ["ggdist"])
    return tx.taxon_association(resid, level=0.1).withColumns({"r": r("r"), "shown": r("shown")})


# ---------------------------------------------------------------- draws


@query("draws_summary", f"""WITH {tv.DRAWS_SQL}
SELECT param, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS support,
round(avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END), 6) AS support_negative FROM draws GROUP BY 1""")
def draws_summary(spark, sf):
    summary = dr.draws_summary(tv.draws(spark, sf))
    return summary.withColumns({c: r(c) for c in ("mean", "support", "support_negative")})


@query("supported_estimates", f"""WITH {tv.DRAWS_SQL}, s AS (
  SELECT param, avg(value) AS mean, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END) AS m FROM draws GROUP BY 1
) SELECT param, round(CASE WHEN p > 0.5 OR m > 0.5 THEN mean ELSE 0.0 END, 6) AS supported FROM s""")
def supported_estimates(spark, sf):
    return dr.supported(dr.draws_summary(tv.draws(spark, sf)), 0.5).select("param", r("supported").alias("supported"))


@query("scale_reduction", f"""WITH {tv.DRAWS_SQL}, c AS (
  SELECT param, chain, avg(value) AS m, var_samp(value) AS s2, CAST(count(*) AS DOUBLE) AS n FROM draws GROUP BY ALL
), p AS (
  SELECT param, CAST(count(*) AS DOUBLE) AS k, avg(n) AS n, avg(s2) AS w, avg(m) AS mu, avg(n) * var_samp(m) AS b, var_samp(s2) AS vs,
         avg(n) / count(*) * (covar_samp(s2, m * m) - 2 * avg(m) * covar_samp(s2, m)) AS cwb FROM c GROUP BY 1
), v AS (SELECT *, (n - 1) / n * w + (1 + 1 / k) * b / n AS v,
  ((n - 1) ** 2 * vs / k + (1 + 1 / k) ** 2 * 2 * b * b / (k - 1) + 2 * (n - 1) * (1 + 1 / k) * cwb) / (n * n) AS vv FROM p)
SELECT param, round(sqrt((2 * v * v / vv + 3) / (2 * v * v / vv + 1) * v / w), 6) AS psrf FROM v""")
def scale_reduction(spark, sf):
    return dr.psrf(tv.draws(spark, sf)).withColumn("psrf", r("psrf"))


_THREE_CHAINS = tv.DRAWS_SQL.replace("event_id % 4", "event_id % 3").replace("event_id / 4", "event_id / 3")


# With three chains the F distribution has two degrees of freedom between chains, and its quantiles a closed form.
@query("scale_reduction_limit", f"""WITH {_THREE_CHAINS}, c AS (
  SELECT param, chain, avg(value) AS m, var_samp(value) AS s2, CAST(count(*) AS DOUBLE) AS n FROM draws GROUP BY ALL
), p AS (
  SELECT param, CAST(count(*) AS DOUBLE) AS k, avg(n) AS n, avg(s2) AS w, avg(m) AS mu, avg(n) * var_samp(m) AS b, var_samp(s2) AS vs,
         avg(n) / count(*) * (covar_samp(s2, m * m) - 2 * avg(m) * covar_samp(s2, m)) AS cwb FROM c GROUP BY 1
), v AS (SELECT *, (n - 1) / n * w + (1 + 1 / k) * b / n AS v, 2 * w * w * k / vs AS dw,
  ((n - 1) ** 2 * vs / k + (1 + 1 / k) ** 2 * 2 * b * b / (k - 1) + 2 * (n - 1) * (1 + 1 / k) * cwb) / (n * n) AS vv FROM p
), f AS (SELECT *, (2 * v * v / vv + 3) / (2 * v * v / vv + 1) AS correction, dw / 2 * (0.025 ** (-2 / dw) - 1) AS quantile FROM v)
SELECT param, round(sqrt(correction * v / w), 6) AS psrf, round(sqrt(correction * ((n - 1) / n + quantile * (1 + 1 / k) * b / n / w)), 6) AS upper FROM f""")
def scale_reduction_limit(spark, sf):
    return dr.psrf(tv.draws(spark, sf, chains=3), confidence=0.95).withColumns({"psrf": r("psrf"), "upper": r("upper")})


@query("renumbered_draws", f"""WITH {tv.DRAWS_SQL}
SELECT chain, param, row_number() OVER (PARTITION BY chain, param ORDER BY iter) - 1 AS iter, value FROM draws""")
def renumbered_draws(spark, sf):
    return dr.renumber_iterations(tv.draws(spark, sf))


@query("effective_sample_size", f"""WITH {tv.DRAWS_SQL}, d AS (
  SELECT chain, param, row_number() OVER (PARTITION BY chain, param ORDER BY iter) - 1 AS iter, value - avg(value) OVER (PARTITION BY chain, param) AS v,
         count(*) OVER (PARTITION BY chain, param) AS n FROM draws
), c AS (
  SELECT a.chain, a.param, b.iter - a.iter AS lag, sum(a.v * b.v) / any_value(a.n) AS c, any_value(a.n) AS n
  FROM d a JOIN d b ON a.chain = b.chain AND a.param = b.param AND b.iter >= a.iter GROUP BY ALL
), g AS (
  SELECT chain, param, lag // 2 AS t, sum(c) AS gamma, max(CASE WHEN lag = 0 THEN c END) AS c0, any_value(n) AS n FROM c GROUP BY ALL HAVING count(*) = 2
), l AS (SELECT chain, param, n, min(gamma) OVER w AS low, max(c0) OVER w AS c0 FROM g WINDOW w AS (PARTITION BY chain, param ORDER BY t)),
e AS (SELECT chain, param, any_value(n) AS n, sum(low) AS total, max(c0) AS c0 FROM l WHERE low > 0 GROUP BY ALL)
SELECT param, round(sum(least(n, n * c0 / (2 * total - c0))), 4) AS ess, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY 1""")
def effective_sample_size(spark, sf):
    return dr.ess(dr.renumber_iterations(tv.draws(spark, sf))).withColumn("ess", r("ess", 4))


@query("spectral_sample_size", f"""WITH RECURSIVE {tv.DRAWS_SQL}, d AS (
  SELECT chain, param, row_number() OVER (PARTITION BY chain, param ORDER BY iter) - 1 AS iter, value - avg(value) OVER (PARTITION BY chain, param) AS v,
         count(*) OVER (PARTITION BY chain, param) AS n FROM draws
), l AS (
  SELECT a.chain, a.param, b.iter - a.iter AS lag, sum(a.v * b.v) / any_value(a.n) AS c, any_value(a.n) AS n
  FROM d a JOIN d b ON a.chain = b.chain AND a.param = b.param AND b.iter BETWEEN a.iter AND a.iter + CAST(floor(least(a.n - 2, 10 * log10(a.n))) AS BIGINT)
  GROUP BY ALL
), c AS (SELECT chain, param, any_value(n) AS n, list(c ORDER BY lag) AS c FROM l GROUP BY ALL HAVING max(CASE WHEN lag = 0 THEN c END) > 0),
steps(chain, param, n, c, k, a, v) AS (
  SELECT chain, param, n, c, 0, CAST([] AS DOUBLE[]), c[1] FROM c
  UNION ALL
  SELECT chain, param, n, c, k + 1, list_append(list_transform(range(1, k + 1), lambda i: a[i] - q * a[k + 1 - i]), q), v * (1 - q * q)
  FROM (SELECT *, (c[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: a[i] * c[k + 2 - i])), 0)) / v AS q FROM steps WHERE k + 1 < len(c))
  WHERE q * q < 1
), best AS (
  SELECT DISTINCT ON (chain, param) * FROM steps ORDER BY chain, param, n * ln(v) + 2 * k, k
)
SELECT param, round(sum(n * (c[1] * n / (n - 1)) * (1 - coalesce(list_sum(a), 0)) ** 2 * (n - k - 1) / (v * n)), 4) AS ess, CAST(sum(n) AS BIGINT) AS n
FROM best GROUP BY 1""")
def spectral_sample_size(spark, sf):
    return dr.ess_spectral(dr.renumber_iterations(tv.draws(spark, sf))).withColumn("ess", r("ess", 4))
