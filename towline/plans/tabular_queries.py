"""Queries for scalar expressions, filters, joins, aggregation, windows and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    as_levels, between_open, classify_boxes, complete_cases, cpue, cut, drop_prefix, is_present,
    n_distinct, not_in, override, paste, recode, relative_to_mean, strip_token, sum_of, mean_of,
)
from ..operators import aggregate as agg
from ..operators import joins, reshape
from ..operators.describe import describe_table
from ..operators.regions import box_table, classify_by_boxes
from ..session import cut as cut_lineage
from ..sources import season_of
from . import testviews as tv
from .fixed import REGION_BOXES, SALINITY_BREAKS, SEASON_OF_MONTH
from .registry import query


def r(col, digits: int = 6):
    return F.round(col, digits)


# ---------------------------------------------------------------- lookup and scalar expressions

_SEASON_CASE = "CASE " + " ".join(
    f"WHEN month = {m} THEN '{s}'" for m, s in SEASON_OF_MONTH.items()
) + " END"


@query("season_lookup", f"""WITH {tv.RAW_SQL}
SELECT {_SEASON_CASE} AS season, month, count(*) AS n, sum(n_count) AS total FROM raw GROUP BY 1, 2""")
def season_lookup(spark, sf):
    seasons = tv.raw(spark, sf).select(season_of("month").alias("season"), "month", "n_count")
    return seasons.groupBy("season", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("n_count").alias("total"))


@query("project_columns", f"""WITH {tv.RAW_SQL}
SELECT site, survey, station, sample_id, "date", n_count, taxon, lifestage FROM raw""")
def project_columns(spark, sf):
    return tv.raw(spark, sf).select("site", "survey", "station", "sample_id", "date", "n_count", "taxon", "lifestage")


@query("drop_by_name_and_prefix", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def drop_by_name_and_prefix(spark, sf):
    return drop_prefix(tv.table(spark, sf, "part").drop("p_name", "p_type"), "P_SIZ")


@query("rename_columns", "SELECT s_suppkey AS station, s_name AS station_name, s_nationkey, s_acctbal AS ggdist FROM supplier")
def rename_columns(spark, sf):
    return tv.table(spark, sf, "supplier").withColumnsRenamed(
        {"s_suppkey": "station", "s_name": "station_name", "s_acctbal": "ggdist"}
    )


@query("derived_column", """SELECT l_orderkey, l_linenumber, l_partkey,
round(l_extendedprice * (1 - l_discount), 6) AS value, l_quantity * 2 AS doubled FROM lineitem""")
def derived_column(spark, sf):
    return tv.table(spark, sf, "lineitem").withColumns({
        "value": r(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "doubled": F.col("l_quantity") * 2,
    }).select("l_orderkey", "l_linenumber", "l_partkey", "value", "doubled")


@query("cpue_arithmetic", f"""WITH {tv.RAW_SQL}
SELECT sample_id, taxon, round(n_count / nullif(cell_number - 1, 0) * dilution / volume, 6) AS cpue FROM raw""")
def cpue_arithmetic(spark, sf):
    # One cell less than counted, so that lines with a single cell have no effort.
    return tv.raw(spark, sf).select(
        "sample_id", "taxon", r(cpue("n_count", F.col("cell_number") - 1, "dilution", "volume")).alias("cpue")
    )


@query("date_parts", """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month,
CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""")
def date_parts(spark, sf):
    return tv.table(spark, sf, "orders").select(
        "o_orderkey", F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year")
    )


@query("parse_date", """SELECT o_orderkey, CAST(try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS "date",
CAST(try_strptime(o_orderpriority, '%Y-%m-%d') AS DATE) AS bad_date FROM orders""")
def parse_date(spark, sf):
    return tv.table(spark, sf, "orders").select(
        "o_orderkey",
        F.try_to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("yyyy-MM-dd")).cast("date").alias("date"),
        F.try_to_timestamp("o_orderpriority", F.lit("yyyy-MM-dd")).cast("date").alias("bad_date"),
    )


@query("cast_leniently", """SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS code,
TRY_CAST(substr(p_brand, 7) AS BIGINT) AS brand_number, TRY_CAST(p_name AS BIGINT) AS not_a_number FROM part""")
def cast_leniently(spark, sf):
    return tv.table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_partkey").cast("string").alias("code"),
        F.substring("p_brand", 7, 10).try_cast("bigint").alias("brand_number"),
        F.col("p_name").try_cast("bigint").alias("not_a_number"),
    )


@query("paste_labels", """SELECT p_partkey, p_brand || ' ' || coalesce(CAST(nullif(p_size, 7) AS VARCHAR), 'NA') AS label,
coalesce(nullif(p_type, 'SMALL'), 'NA') || '-' || CAST(p_partkey AS VARCHAR) AS sample_id FROM part""")
def paste_labels(spark, sf):
    return tv.table(spark, sf, "part").select(
        "p_partkey",
        paste("p_brand", F.nullif(F.col("p_size"), F.lit(7))).alias("label"),
        paste(F.nullif(F.col("p_type"), F.lit("SMALL")), "p_partkey", sep="-").alias("sample_id"),
    )


@query("strip_token", """SELECT c_custkey, replace(c_name, '00', '') AS short_name FROM customer""")
def strip_token_query(spark, sf):
    return tv.table(spark, sf, "customer").select("c_custkey", strip_token("c_name", "00").alias("short_name"))


@query("log_and_half_even", """SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 6) AS log_catch,
CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS rounded FROM lineitem""")
def log_and_half_even(spark, sf):
    return tv.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        r(F.ln("l_extendedprice")).alias("log_catch"),
        F.bround(F.col("l_quantity") / 2, 0).cast("bigint").alias("rounded"),
    )


@query("recode_values", f"""WITH {tv.RAW_SQL}
SELECT CASE taxon WHEN 'Brand#1' THEN 'lumped' WHEN 'Brand#2' THEN 'lumped' WHEN 'Brand#3' THEN 'other' ELSE taxon END AS taxon2,
count(*) AS n, sum(n_count) AS total FROM raw GROUP BY 1""")
def recode_values(spark, sf):
    lumped = recode("taxon", {"Brand#1": "lumped", "Brand#2": "lumped", "Brand#3": "other"})
    return tv.raw(spark, sf).groupBy(lumped.alias("taxon2")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_count").alias("total")
    )


@query("conditional_override", f"""WITH {tv.RAW_SQL}
SELECT sample_id, station, year, CASE WHEN site = 'NATION_3' AND year > 1998 THEN 'Tidal' ELSE region END AS region FROM raw""")
def conditional_override(spark, sf):
    changed = override(tv.raw(spark, sf), "region", (F.col("site") == "NATION_3") & (F.col("year") > 1998), "Tidal")
    return changed.select("sample_id", "station", "year", "region")


@query("ordered_levels", """SELECT p_partkey,
CASE p_type WHEN 'SMALL' THEN 'S' WHEN 'MEDIUM' THEN 'M' WHEN 'LARGE' THEN 'L' END AS size_class,
CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 END AS size_class_ord FROM part""")
def ordered_levels(spark, sf):
    part = tv.table(spark, sf, "part")
    return as_levels(part, "p_type", ["SMALL", "MEDIUM", "LARGE"], ["S", "M", "L"], out="size_class").select(
        "p_partkey", "size_class", "size_class_ord"
    )


def _cut_case(column: str, breaks) -> str:
    bins = zip(breaks, breaks[1:])
    return "CASE " + " ".join(f"WHEN {column} > {a} AND {column} <= {b} THEN '({a:g},{b:g}]'" for a, b in bins) + " END"


@query("salinity_bins", f"""WITH {tv.RAW_SQL}
SELECT sample_id, sal, {_cut_case('sal', SALINITY_BREAKS)} AS salbin FROM raw""")
def salinity_bins(spark, sf):
    return tv.raw(spark, sf).select("sample_id", "sal", cut("sal", SALINITY_BREAKS).alias("salbin"))


_BOX_CASE = "CASE " + " ".join(
    "WHEN " + " AND ".join(f"{axis} {op} {limit}" for axis, op, limit in bounds) + f" THEN '{name}'"
    for name, bounds in reversed(REGION_BOXES)
) + " END"


@query("region_boxes", f"""WITH {tv.STATIONS_SQL}
SELECT station, {_BOX_CASE} AS box FROM stations""")
def region_boxes(spark, sf):
    return classify_boxes(tv.stations(spark, sf), "lat", "lon", REGION_BOXES, out="box").select("station", "box")


@query("region_boxes_indexed", f"""WITH {tv.STATIONS_SQL}
SELECT station, {_BOX_CASE} AS box FROM stations""")
def region_boxes_indexed(spark, sf):
    stations = tv.stations(spark, sf)
    return classify_by_boxes(stations, "lat", "lon", box_table(spark, REGION_BOXES), out="box").select("station", "box")


# As many boxes as there are parts, of very different sizes, over as many positions as there are orders.
@query("regions_of_many_boxes", """WITH boxes AS (
  SELECT p_name AS name, p_partkey AS priority, 37 + (p_partkey * 31 % 1900) / 1000.0 AS lat_low, -123 + (p_partkey * 17 % 2900) / 1000.0 AS lon_low,
         p_size / 200.0 / (1 + p_partkey % 7) AS height, p_size / 300.0 / (1 + p_partkey % 11) AS width FROM part
), points AS (SELECT o_orderkey, 37 + (o_orderkey * 7919 % 2000) / 1000.0 AS lat, -123 + (o_orderkey * 104729 % 3000) / 1000.0 AS lon FROM orders),
named AS (
  SELECT o_orderkey, arg_max(name, priority) AS name FROM points JOIN boxes
  ON lat >= lat_low AND lat < lat_low + height AND lon > lon_low AND lon <= lon_low + width GROUP BY 1
)
SELECT o_orderkey, name FROM points LEFT JOIN named USING (o_orderkey)""")
def regions_of_many_boxes(spark, sf):
    key = F.col("p_partkey")
    low, left = F.lit(37) + key * 31 % 1900 / 1000.0, F.lit(-123) + key * 17 % 2900 / 1000.0
    boxes = tv.table(spark, sf, "part").select(
        F.col("p_name").alias("name"), key.alias("priority"), low.alias("lat_low"), F.lit(False).alias("lat_low_open"),
        (low + F.col("p_size") / 200.0 / (1 + key % 7)).alias("lat_high"), F.lit(True).alias("lat_high_open"), left.alias("lon_low"),
        F.lit(True).alias("lon_low_open"), (left + F.col("p_size") / 300.0 / (1 + key % 11)).alias("lon_high"), F.lit(False).alias("lon_high_open"))
    order = F.col("o_orderkey")
    points = tv.table(spark, sf, "orders").select(
        order, (F.lit(37) + order * 7919 % 2000 / 1000.0).alias("lat"), (F.lit(-123) + order * 104729 % 3000 / 1000.0).alias("lon"))
    return classify_by_boxes(points, "lat", "lon", boxes, out="name").select("o_orderkey", "name")


@query("constant_tag", """SELECT s_suppkey AS station, 'shore' AS survey FROM supplier""")
def constant_tag(spark, sf):
    return tv.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station"), F.lit("shore").alias("survey"))


@query("relative_to_mean", """SELECT s_suppkey, round(0.1 + s_acctbal / avg(s_acctbal) OVER (), 6) AS relative,
round(max(s_acctbal) OVER () - min(s_acctbal) OVER (), 6) AS relative_range FROM supplier""")
def relative_to_mean_query(spark, sf):
    scaled = relative_to_mean(tv.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")
    return scaled.select("s_suppkey", r("relative").alias("relative"), r("relative_range").alias("relative_range"))


# ---------------------------------------------------------------- filters


@query("value_membership", f"""WITH {tv.RAW_SQL}
SELECT sample_id, station, taxon, month, year FROM raw WHERE month IN (3, 4, 5, 6) AND year IN (1997, 1998, 1999)""")
def value_membership(spark, sf):
    kept = tv.raw(spark, sf).filter(F.col("month").isin(3, 4, 5, 6) & F.col("year").isin(1997, 1998, 1999))
    return kept.select("sample_id", "station", "taxon", "month", "year")


@query("exclusion_keeping_null", """WITH p AS (SELECT p_partkey, nullif(p_type, 'SMALL') AS kind FROM part)
SELECT p_partkey, kind FROM p WHERE kind IS NULL OR kind NOT IN ('LARGE', 'MEDIUM')""")
def exclusion_keeping_null(spark, sf):
    part = tv.table(spark, sf, "part").select("p_partkey", F.nullif(F.col("p_type"), F.lit("SMALL")).alias("kind"))
    return part.filter(not_in("kind", ["LARGE", "MEDIUM"]))


@query("open_date_range", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "date" FROM orders
WHERE CAST(o_orderdate AS DATE) > DATE '1997-01-01' AND CAST(o_orderdate AS DATE) < DATE '1998-06-20'""")
def open_date_range(spark, sf):
    dated = tv.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return dated.filter(between_open("date", F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1998-06-20"))))


@query("inequalities_drop_null", """WITH p AS (SELECT p_partkey, nullif(p_type, 'SMALL') AS kind, nullif(p_size, 7) AS size FROM part)
SELECT p_partkey, kind, size FROM p WHERE kind <> 'LARGE' AND kind <> 'ECONOMY' AND size <> 9""")
def inequalities_drop_null(spark, sf):
    part = tv.table(spark, sf, "part").select(
        "p_partkey", F.nullif(F.col("p_type"), F.lit("SMALL")).alias("kind"),
        F.nullif(F.col("p_size"), F.lit(7)).alias("size"),
    )
    return part.filter((F.col("kind") != "LARGE") & (F.col("kind") != "ECONOMY") & (F.col("size") != 9))


@query("present_values", """WITH p AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL WHEN p_size = 9 THEN '' ELSE p_brand END AS code FROM part)
SELECT p_partkey, code FROM p WHERE code IS NOT NULL AND code <> ''""")
def present_values(spark, sf):
    code = F.when(F.col("p_size") == 7, None).when(F.col("p_size") == 9, "").otherwise(F.col("p_brand"))
    return tv.table(spark, sf, "part").select("p_partkey", code.alias("code")).filter(is_present("code"))


@query("equality_filters", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity >= 25""")
def equality_filters(spark, sf):
    lines = tv.table(spark, sf, "lineitem")
    kept = lines.filter((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 25))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("complete_cases", """WITH p AS (SELECT p_partkey, nullif(p_size, 7) AS size, nullif(p_brand, 'Brand#5') AS brand FROM part)
SELECT p_partkey, size, brand FROM p WHERE size IS NOT NULL AND brand IS NOT NULL""")
def complete_cases_query(spark, sf):
    part = tv.table(spark, sf, "part").select(
        "p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("size"),
        F.nullif(F.col("p_brand"), F.lit("Brand#5")).alias("brand"),
    )
    return complete_cases(part, ["size", "brand"])


# ---------------------------------------------------------------- joins


def _coded_parts(spark, sf):
    """Parts with a class code that is NULL for one size."""
    return tv.table(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"), F.nullif(F.col("p_size"), F.lit(7)).alias("size_code")
    )


def _size_classes(spark, sf):
    """Class table over the sizes moved up by four, with a NULL code of its own and one duplicated code."""
    sizes = tv.table(spark, sf, "part").select((F.col("p_size") + 4).alias("p_size")).distinct()
    coded = sizes.select(F.nullif(F.col("p_size"), F.lit(7)).alias("size_code"), (F.col("p_size") % 3).alias("size_class"))
    again = sizes.filter("p_size = 11").select(F.col("p_size").alias("size_code"), F.lit(9).alias("size_class"))
    return reshape.stack(coded, again)


_CODED_SQL = """coded AS (SELECT p_partkey AS part_id, nullif(p_size, 7) AS size_code FROM part),
classes AS (
  SELECT DISTINCT nullif(p_size + 4, 7) AS size_code, (p_size + 4) % 3 AS size_class FROM part
  UNION ALL SELECT DISTINCT p_size + 4, 9 FROM part WHERE p_size + 4 = 11
)"""


@query("natural_inner_join", f"""WITH {_CODED_SQL}
SELECT c.size_code, part_id, size_class FROM coded c JOIN classes k ON c.size_code IS NOT DISTINCT FROM k.size_code""")
def natural_inner_join(spark, sf):
    return joins.natural_join(_coded_parts(spark, sf), _size_classes(spark, sf), "inner")


@query("inner_join_named_key", """WITH allow AS (
  SELECT o_orderkey AS sample_id FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
) SELECT l_orderkey AS sample_id, l_linenumber, l_quantity FROM lineitem JOIN allow ON l_orderkey = sample_id""")
def inner_join_named_key(spark, sf):
    done = tv.table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    allow = reshape.stack(
        done.select(F.col("o_orderkey").alias("sample_id")),
        done.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("sample_id")),
    )
    lines = tv.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_linenumber", "l_quantity")
    return joins.natural_join(lines, allow, "inner", by=["sample_id"])


@query("natural_left_join", f"""WITH {_CODED_SQL}
SELECT c.size_code, part_id, size_class FROM coded c LEFT JOIN classes k ON c.size_code IS NOT DISTINCT FROM k.size_code""")
def natural_left_join(spark, sf):
    return joins.natural_join(_coded_parts(spark, sf), _size_classes(spark, sf), "left")


@query("left_join_named_key", f"""WITH {tv.STATIONS_SQL}
SELECT station, site, count(l_orderkey) AS n_lines, sum(l_quantity) AS total
FROM stations LEFT JOIN lineitem ON l_suppkey + 3 = station GROUP BY 1, 2""")
def left_join_named_key(spark, sf):
    # Numbers moved by three, so that both sides have keys without partner.
    lines = tv.table(spark, sf, "lineitem").select((F.col("l_suppkey") + 3).alias("station"), "l_orderkey", "l_quantity")
    # Lines are reduced per station before the join, so a busy station is one row in it.
    totals = lines.groupBy("station").agg(F.count("l_orderkey").alias("n_lines"), F.sum("l_quantity").alias("total"))
    return joins.natural_join(tv.stations(spark, sf).select("station", "site"), totals, "left", by=["station"]).select(
        "station", "site", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "total"
    )


@query("natural_right_join", f"""WITH {_CODED_SQL}
SELECT c.size_code, part_id, size_class FROM classes k RIGHT JOIN coded c ON c.size_code IS NOT DISTINCT FROM k.size_code""")
def natural_right_join(spark, sf):
    return joins.natural_join(_size_classes(spark, sf), _coded_parts(spark, sf), "right")


@query("anti_join", f"""WITH {_CODED_SQL}
SELECT part_id, size_code FROM coded c WHERE NOT EXISTS (SELECT 1 FROM classes k WHERE k.size_code IS NOT DISTINCT FROM c.size_code)""")
def anti_join(spark, sf):
    return joins.natural_join(_coded_parts(spark, sf), _size_classes(spark, sf), "left_anti")


@query("append_without_duplicates", """WITH old AS (SELECT l_orderkey AS sample_id, l_quantity FROM lineitem WHERE l_linestatus = 'F'),
new AS (SELECT l_orderkey AS sample_id, l_quantity FROM lineitem)
SELECT sample_id, l_quantity, 'old' AS extract FROM old
UNION ALL SELECT sample_id, l_quantity, 'new' FROM new WHERE sample_id NOT IN (SELECT sample_id FROM old)""")
def append_without_duplicates(spark, sf):
    lines = tv.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_quantity", "l_linestatus")
    old = lines.filter("l_linestatus = 'F'").drop("l_linestatus")
    added = joins.drop_keys(lines.drop("l_linestatus"), old, "sample_id")
    return reshape.stack(old.withColumn("extract", F.lit("old")), added.withColumn("extract", F.lit("new")))


@query("duplicate_samples", """SELECT l_orderkey AS sample_id, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def duplicate_samples(spark, sf):
    pending = tv.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("sample_id"))
    lines = tv.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_linenumber", "l_quantity")
    return joins.keep_keys(lines, pending, "sample_id")


@query("expand_keys", f"""WITH {tv.RAW_SQL}
SELECT survey, site, month, year FROM (SELECT DISTINCT survey FROM raw), (SELECT DISTINCT site FROM raw),
(SELECT DISTINCT month FROM raw), (SELECT DISTINCT year FROM raw)""")
def expand_keys(spark, sf):
    return joins.expand(tv.raw(spark, sf), ["survey", "site", "month", "year"])


@query("join_audit", """WITH b AS (SELECT DISTINCT replace(p_brand, '#9', '#90') AS brand, p_type AS kind FROM part),
a AS (SELECT DISTINCT replace(p_brand, '#4', '#40') AS brand, p_type AS kind FROM part)
SELECT 'unmatched_left' AS kind, brand AS key, count(*) AS n FROM b WHERE brand NOT IN (SELECT brand FROM a) GROUP BY brand
UNION ALL SELECT 'unmatched_right', brand, count(*) FROM a WHERE brand NOT IN (SELECT brand FROM b) GROUP BY brand
UNION ALL SELECT 'duplicate_right', brand, count(*) FROM a GROUP BY brand HAVING count(*) > 1
UNION ALL SELECT 'conflict:kind', brand, count(DISTINCT kind) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
  WHERE brand IN (SELECT brand FROM a) AND brand IN (SELECT brand FROM b) GROUP BY brand HAVING count(DISTINCT kind) > 1""")
def join_audit_query(spark, sf):
    part = tv.table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    left = part.select(F.replace("brand", F.lit("#9"), F.lit("#90")).alias("brand"), "kind").distinct()
    right = part.select(F.replace("brand", F.lit("#4"), F.lit("#40")).alias("brand"), "kind").distinct()
    return joins.join_audit(left, right, ["brand"], compare=["kind"])


@query("match_stations", f"""WITH {tv.CATCH_SQL}, cross_walk AS (
  SELECT n_name AS site, CAST(s_suppkey AS VARCHAR) AS code_a, CAST(nullif(s_suppkey % 7, 0) AS VARCHAR) AS code_b
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), matched AS (
  SELECT w.site AS matched_site, 'code_a' AS matched_by, c.station, c.cpue FROM catch c JOIN cross_walk w ON CAST(c.station AS VARCHAR) = w.code_a
  UNION ALL
  SELECT w.site, 'code_b', c.station, c.cpue FROM catch c JOIN cross_walk w ON CAST(c.station AS VARCHAR) = w.code_b
) SELECT matched_site, matched_by, CAST(station AS VARCHAR) AS station, count(*) AS n, round(sum(cpue), 4) AS cpue FROM matched GROUP BY 1, 2, 3""")
def match_stations_query(spark, sf):
    crosswalk = tv.stations(spark, sf).select(
        F.col("site").alias("matched_site"),
        F.col("station").alias("code_a"),
        F.nullif(F.col("station") % 7, F.lit(0)).alias("code_b"),
    )
    # Catch is reduced per station first: matching multiplies station rows, not catch lines.
    by_station = tv.catch(spark, sf).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("cpue").alias("cpue"))
    matched = joins.match_stations(by_station, crosswalk, ["code_a", "code_b"], site="matched_site", station="station")
    return matched.groupBy("matched_site", "matched_by", "station").agg(
        F.sum("n").alias("n"), r(F.sum("cpue"), 4).alias("cpue")
    )


# ---------------------------------------------------------------- aggregation


@query("grouped_sum", """WITH p AS (SELECT p_brand, CAST(nullif(p_size, 7) AS DOUBLE) AS size FROM part)
SELECT p_brand, CASE WHEN bool_or(size IS NULL) THEN NULL ELSE sum(size) END AS strict_sum, coalesce(sum(size), 0) AS known_sum FROM p GROUP BY 1""")
def grouped_sum(spark, sf):
    part = tv.table(spark, sf, "part").select("p_brand", F.nullif(F.col("p_size"), F.lit(7)).cast("double").alias("size"))
    return part.groupBy("p_brand").agg(
        sum_of("size", skip_null=False).alias("strict_sum"), sum_of("size", skip_null=True).alias("known_sum")
    )


@query("grouped_mean", """WITH p AS (SELECT p_brand, p_type, CAST(nullif(p_size, 7) AS DOUBLE) AS size FROM part)
SELECT p_brand, p_type, round(CASE WHEN bool_or(size IS NULL) THEN NULL ELSE avg(size) END, 6) AS strict_mean,
round(avg(size), 6) AS known_mean FROM p GROUP BY 1, 2""")
def grouped_mean(spark, sf):
    part = tv.table(spark, sf, "part").select(
        "p_brand", "p_type", F.nullif(F.col("p_size"), F.lit(7)).cast("double").alias("size")
    )
    return part.groupBy("p_brand", "p_type").agg(
        r(mean_of("size", skip_null=False)).alias("strict_mean"), r(mean_of("size", skip_null=True)).alias("known_mean")
    )


@query("grouped_max", f"""WITH {tv.RAW_SQL}
SELECT survey, max("date") AS latest, max(cell_number) AS cells FROM raw GROUP BY 1""")
def grouped_max(spark, sf):
    return tv.raw(spark, sf).groupBy("survey").agg(F.max("date").alias("latest"), F.max("cell_number").alias("cells"))


@query("sample_sizes", f"""WITH {tv.RAW_SQL}
SELECT station, month, year, count(DISTINCT sample_id) + max(CASE WHEN sample_id IS NULL THEN 1 ELSE 0 END) AS n FROM raw GROUP BY 1, 2, 3""")
def sample_sizes(spark, sf):
    return agg.n_samples(tv.raw(spark, sf), ["station", "month", "year"], "sample_id")


@query("mean_sd_se", f"""WITH {tv.CATCH_SQL}
SELECT region, lifestage, round(avg(cpue), 6) AS mean, round(stddev_samp(cpue), 6) AS sd, count(*) AS n,
round(stddev_samp(cpue) / count(*), 9) AS se FROM catch GROUP BY 1, 2""")
def mean_sd_se_query(spark, sf):
    stats = agg.mean_sd_se(tv.catch(spark, sf), ["region", "lifestage"], "cpue", se_mode="n")
    return stats.select("region", "lifestage", r("mean").alias("mean"), r("sd").alias("sd"), "n", r("se", 9).alias("se"))


@query("slides_to_cpue", f"""WITH {tv.CATCH_SQL}
SELECT sample_id, station, "date", dilution, taxon, lifestage, volume, tot_count, tot_cells, tot_count_all, round(cpue, 6) AS cpue FROM catch""")
def slides_to_cpue_query(spark, sf):
    return tv.catch(spark, sf).select(
        "sample_id", "station", "date", "dilution", "taxon", "lifestage", "volume", "tot_count", "tot_cells",
        "tot_count_all", r("cpue").alias("cpue"),
    )


@query("mean_of_totals", f"""WITH {tv.CATCH_SQL}, totals AS (
  SELECT sample_id, taxon, lifestage, region, month, survey, year, sum(cpue) AS total, avg(ggdist) AS ggdist FROM catch GROUP BY ALL
) SELECT taxon, lifestage, region, month, survey, year, round(avg(total), 6) AS mean, count(*) AS n_totals, round(avg(ggdist), 6) AS mean_ggdist
FROM totals GROUP BY 1, 2, 3, 4, 5, 6""")
def mean_of_totals_query(spark, sf):
    strata = ["taxon", "lifestage", "region", "month", "survey", "year"]
    means = agg.mean_of_totals(tv.catch(spark, sf), ["sample_id", *strata], strata, "cpue", also_mean=["ggdist"])
    return means.select(*strata, r("mean").alias("mean"), "n_totals", r("mean_ggdist").alias("mean_ggdist"))


@query("cascade_mean", f"""WITH {tv.CATCH_SQL},
a AS (SELECT site, month, survey, year, taxon, avg(cpue) AS m FROM catch GROUP BY ALL),
b AS (SELECT month, survey, year, taxon, avg(m) AS m FROM a GROUP BY ALL)
SELECT survey, taxon, round(avg(m), 6) AS mean FROM b GROUP BY 1, 2""")
def cascade_mean_query(spark, sf):
    levels = [["site", "month", "survey", "year", "taxon"], ["month", "survey", "year", "taxon"], ["survey", "taxon"]]
    return agg.cascade_mean(tv.catch(spark, sf), levels, "cpue").select("survey", "taxon", r("mean").alias("mean"))


@query("share_of_total", f"""WITH {tv.CATCH_SQL}
SELECT taxon, lifestage, round(sum(cpue), 4) AS total, round(sum(cpue) / (SELECT sum(cpue) FROM catch), 6) AS share FROM catch GROUP BY 1, 2""")
def share_of_total_query(spark, sf):
    shares = agg.share_of_total(tv.catch(spark, sf), ["taxon", "lifestage"], "cpue")
    return shares.select("taxon", "lifestage", r("total", 4).alias("total"), r("share").alias("share"))


@query("lump_rare", f"""WITH {tv.CATCH_SQL}, shares AS (
  SELECT taxon, sum(cpue) / (SELECT sum(cpue) FROM catch) AS share FROM catch GROUP BY 1
) SELECT region, CASE WHEN share < 0.04 THEN 'other' ELSE taxon END AS lumped, count(*) AS n, round(sum(cpue), 4) AS cpue
FROM catch JOIN shares USING (taxon) GROUP BY 1, 2""")
def lump_rare_query(spark, sf):
    lumped = agg.lump_rare(tv.catch(spark, sf), "taxon", "cpue", 0.04)
    return lumped.groupBy("region", "lumped").agg(F.count(F.lit(1)).alias("n"), r(F.sum("cpue"), 4).alias("cpue"))


@query("drop_zero_categories", """WITH w AS (SELECT l_suppkey, p_brand, CASE WHEN p_brand IN ('Brand#3', 'Brand#7') THEN 0 ELSE l_quantity END AS catch
FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_suppkey, p_brand, sum(catch) AS catch FROM w WHERE p_brand IN (SELECT p_brand FROM w GROUP BY 1 HAVING sum(catch) <> 0) GROUP BY 1, 2""")
def drop_zero_categories_query(spark, sf):
    lines = tv.table(spark, sf, "lineitem").join(tv.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    catch = lines.select(
        "l_suppkey", "p_brand",
        F.when(F.col("p_brand").isin("Brand#3", "Brand#7"), F.lit(0.0)).otherwise(F.col("l_quantity")).alias("catch"),
    )
    return agg.drop_zero_categories(catch, "p_brand", "catch").groupBy("l_suppkey", "p_brand").agg(F.sum("catch").alias("catch"))


_ENV_KEYS = ["sample_id", "month", "volume", "year", "date", "sal", "lat", "lon", "station", "region"]


@query("environment_rows", f"""WITH {tv.CATCH_ENV_SQL}
SELECT sample_id, month, volume, year, "date", sal, round(lat, 6) AS lat, round(lon, 6) AS lon, station, region, round(sum(cpue), 6) AS tot
FROM catch_env GROUP BY sample_id, month, volume, year, "date", sal, lat, lon, station, region""")
def environment_rows(spark, sf):
    env = agg.env_table(tv.catch_env(spark, sf), _ENV_KEYS, "cpue")
    return env.withColumns({"lat": r("lat"), "lon": r("lon"), "tot": r("tot")})


@query("biomass", f"""WITH {tv.CATCH_ENV_SQL}, b AS (
  SELECT month, year, survey, sample_id, station, volume, sum(cpue * p_retailprice) AS bpue
  FROM catch_env JOIN part ON part_id = p_partkey WHERE p_size <> 7 GROUP BY ALL
) SELECT month, year, survey, round(avg(bpue), 4) AS bpue FROM b GROUP BY 1, 2, 3""")
def biomass(spark, sf):
    # Parts of one size have no conversion factor and drop out of the join.
    conversion = tv.table(spark, sf, "part").filter("p_size <> 7").select(
        F.col("p_partkey").alias("part_id"), F.col("p_retailprice").alias("factor")
    )
    catch = agg.to_biomass(tv.catch_env(spark, sf), conversion, ["part_id"], "factor")
    strata = ["month", "year", "survey"]
    means = agg.mean_of_totals(catch, [*strata, "sample_id", "station", "volume"], strata, "bpue", skip_null=False, out="bpue")
    return means.select(*strata, r("bpue", 4).alias("bpue"))


@query("describe_table", """WITH v AS (
  SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem
  UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT 'l_tax', nullif(l_tax, 0.05) FROM lineitem
) SELECT "column", round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
round(avg(v), 6) AS mean, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max, count(*) - count(v) AS n_null FROM v GROUP BY 1""")
def describe_table_query(spark, sf):
    lines = tv.table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", F.nullif(F.col("l_tax"), F.lit(0.05)).alias("l_tax")
    )
    summary = describe_table(lines)
    numbers = ["min", "q1", "median", "mean", "q3", "max"]
    return summary.withColumns({c: r(c) for c in numbers})


_PRICE_BREAKS = list(range(0, 110000, 10000))
_LOG_BREAKS = [x / 2 for x in range(12, 26)]


@query("histogram", f"""SELECT 'plain' AS scale, {_cut_case('l_extendedprice', _PRICE_BREAKS)} AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2
UNION ALL SELECT 'log', {_cut_case('ln(l_extendedprice)', _LOG_BREAKS)}, count(*) FROM lineitem GROUP BY 1, 2""")
def histogram_query(spark, sf):
    lines = tv.table(spark, sf, "lineitem").select("l_extendedprice")
    plain = agg.histogram(lines, "l_extendedprice", _PRICE_BREAKS).withColumn("scale", F.lit("plain"))
    logged = agg.histogram(lines, "l_extendedprice", _LOG_BREAKS, log_scale=True).withColumn("scale", F.lit("log"))
    return reshape.stack(plain, logged)


# ---------------------------------------------------------------- windows, order, sets, shapes


@query("percent_composition", f"""WITH {tv.CATCH_SQL}, t AS (SELECT region, month, taxon, sum(cpue) AS total FROM catch GROUP BY ALL)
SELECT region, month, taxon, round(total, 4) AS total, round(total / sum(total) OVER (PARTITION BY region, month), 6) AS share FROM t""")
def percent_composition(spark, sf):
    shares = agg.composition(tv.catch(spark, sf), ["region", "month"], "taxon", "cpue")
    return shares.select("region", "month", "taxon", r("total", 4).alias("total"), r("share").alias("share"))


@query("stacked_totals", f"""WITH {tv.CATCH_SQL}, t AS (SELECT survey, year, taxon, sum(cpue) AS total FROM catch GROUP BY ALL),
s AS (SELECT *, sum(total) OVER (PARTITION BY survey, year ORDER BY taxon) AS upper FROM t)
SELECT survey, year, taxon, round(total, 4) AS total, round(upper, 4) AS upper, round(upper - total, 4) AS lower FROM s""")
def stacked_totals(spark, sf):
    bars = agg.stacked(tv.catch(spark, sf), ["survey", "year"], "taxon", "cpue")
    return bars.select(
        "survey", "year", "taxon", r("total", 4).alias("total"), r("upper", 4).alias("upper"), r("lower", 4).alias("lower")
    )


@query("relative_abundance", f"""WITH {tv.CATCH_SQL}, c AS (SELECT sample_id, taxon, sum(cpue) AS cpue FROM catch GROUP BY ALL)
SELECT sample_id, taxon, round(cpue, 9) AS cpue, round(cpue / sum(cpue) OVER (PARTITION BY sample_id), 12) AS relative FROM c""")
def relative_abundance_query(spark, sf):
    rel = agg.relative_abundance(tv.catch(spark, sf), "sample_id", "taxon", "cpue")
    return rel.withColumns({"cpue": r("cpue", 9), "relative": r("relative", 12)})


@query("arrange_nulls_last", """SELECT p_partkey, nullif(p_size, 7) AS size, p_brand FROM part ORDER BY size NULLS LAST, p_brand, p_partkey""")
def arrange_nulls_last(spark, sf):
    part = tv.table(spark, sf, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("size"), "p_brand")
    return reshape.arrange(part, "size", "p_brand", "p_partkey")


@query("sort_columns", """SELECT c_custkey, c_acctbal, c_mktsegment, c_name, c_nationkey FROM customer""")
def sort_columns_query(spark, sf):
    return reshape.sort_columns(tv.table(spark, sf, "customer"), first=["c_custkey"])


@query("stack_by_name", """SELECT s_suppkey AS code, s_acctbal AS amount, 'a' AS survey FROM supplier
UNION ALL SELECT c_custkey, c_acctbal, 'b' FROM customer""")
def stack_by_name(spark, sf):
    first = tv.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("amount"), F.lit("a").alias("survey"))
    second = tv.table(spark, sf, "customer").select(
        F.lit("b").alias("survey"), F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("code"))
    return reshape.stack(first, second)


@query("distinct_rows", """SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem""")
def distinct_rows(spark, sf):
    return tv.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("wide_to_long", """SELECT l_orderkey, l_partkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 'l_extendedprice', l_extendedprice FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 'l_discount', l_discount FROM lineitem""")
def wide_to_long(spark, sf):
    lines = tv.table(spark, sf, "lineitem")
    values = reshape.columns_between(lines, "l_quantity", "l_discount")
    return reshape.to_long(lines, ["l_orderkey", "l_partkey", "l_linenumber"], values, "measure", "amount")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("community_matrix", f"""WITH {tv.CATCH_SQL}, c AS (SELECT sample_id, tax3, sum(n_count) AS x FROM raw GROUP BY ALL)
SELECT sample_id, {', '.join(f"coalesce(sum(CASE WHEN tax3 = '{t}' THEN x END), 0) AS {t}" for t in _TYPES)} FROM c GROUP BY 1""")
def community_matrix_query(spark, sf):
    return reshape.community_matrix(tv.raw(spark, sf), ["sample_id"], "tax3", "n_count", _TYPES)


@query("community_long_zero_filled", f"""WITH {tv.RAW_SQL}, c AS (SELECT sample_id, taxon, sum(n_count) AS n_count FROM raw GROUP BY ALL)
SELECT u.sample_id, t.taxon, coalesce(c.n_count, 0) AS n_count FROM (SELECT DISTINCT sample_id FROM raw) u
CROSS JOIN (SELECT DISTINCT taxon FROM raw) t LEFT JOIN c ON c.sample_id = u.sample_id AND c.taxon = t.taxon""")
def community_long_zero_filled(spark, sf):
    return reshape.community_long(tv.raw(spark, sf), "sample_id", "taxon", "n_count", zero_fill=True)


@query("environment_and_matrix", f"""WITH {tv.UNIT_ENV_SQL}, c AS (
  SELECT l_suppkey AS unit, p_type, sum(l_quantity) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
) SELECT env.unit, region, site, ggdist, reach, {', '.join(f"coalesce(sum(CASE WHEN p_type = '{t}' THEN x END), 0) AS {t}" for t in _TYPES)}
FROM env JOIN c USING (unit) GROUP BY 1, 2, 3, 4, 5""")
def environment_and_matrix(spark, sf):
    lines = tv.table(spark, sf, "lineitem").join(tv.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    matrix = reshape.community_matrix(
        lines.select(F.col("l_suppkey").alias("unit"), "p_type", "l_quantity"), ["unit"], "p_type", "l_quantity", _TYPES
    )
    return joins.natural_join(tv.unit_env(spark, sf), matrix, "inner", by=["unit"])


@query("balanced_strata", f"""WITH {tv.CATCH_SQL}, m AS (SELECT site, month, survey, year, taxon, avg(cpue) AS mean FROM catch GROUP BY ALL),
full_cells AS (SELECT site, month, year FROM m GROUP BY ALL HAVING count(DISTINCT survey) = (SELECT count(DISTINCT survey) FROM m))
SELECT site, month, survey, year, taxon, round(mean, 6) AS mean FROM m JOIN full_cells USING (site, month, year)""")
def balanced_strata(spark, sf):
    # The means are read twice, so they are written once.
    means = cut_lineage(agg.cascade_mean(tv.catch(spark, sf), [["site", "month", "survey", "year", "taxon"]], "cpue"))
    return reshape.balanced(means, ["site", "month", "year"], "survey").withColumn("mean", r("mean"))


@query("distinct_with_null", """SELECT p_brand, count(DISTINCT nullif(p_type, 'SMALL')) + max(CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END) AS n FROM part GROUP BY 1""")
def distinct_with_null(spark, sf):
    part = tv.table(spark, sf, "part").select("p_brand", F.nullif(F.col("p_type"), F.lit("SMALL")).alias("kind"))
    return part.groupBy("p_brand").agg(n_distinct("kind").alias("n"))
