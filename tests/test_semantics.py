"""NULL handling, bins, labels and joins on small rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from towline.functions import (
    as_levels, between_open, classify_boxes, complete_cases, cpue, cut, drop_prefix, is_present, mean_of, n_distinct,
    not_in, override, paste, recode, relative_to_mean, strip_token, sum_of,
)
from towline.operators import aggregate as agg
from towline.operators.joins import drop_keys, expand, join_audit, keep_keys, match_stations, natural_join
from towline.operators.reshape import (
    arrange, balanced, columns_between, community_long, community_matrix, sort_columns, stack, to_long,
)
from towline.plans.fixed import REGION_BOXES, SALINITY_BREAKS
from towline.sources import lookup_df, season_of


def one(spark, column, schema="a int", value=None):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


def test_right_closed_bins(spark):
    values = [0.0, 1.0, 1.5, 7.0, 10.0, 35.0, 35.1, None]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    got = [r[0] for r in df.select(cut("s", SALINITY_BREAKS)).collect()]
    assert got == [None, "(0,1]", "(1,2]", "(6,7]", "(7,10]", "(30,35]", None, None]


def test_region_boxes_borders_and_gaps(spark):
    points = [
        (38.0, -122.3, "SBP"), (38.2, -122.3, "Napa"), (38.084, -122.3, "Napa"), (38.0, -122.0, "Suisun"),
        (38.0, -122.194, "Suisun"), (38.0, -121.875, "Suisun"), (38.05, -121.8, "Confluence"),
        (38.0, -121.6, "SCDelta"), (38.0, -121.699, "SCDelta"), (38.2, -121.7, "Cache"), (37.9, -121.8, None), (None, -122.0, "Suisun"),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in points], "lat double, lon double")
    assert [r["region"] for r in classify_boxes(df, "lat", "lon", REGION_BOXES).collect()] == [p[2] for p in points]


def test_last_box_wins(spark):
    rules = [("a", [("lat", "<", 10)]), ("b", [("lat", "<", 5)])]
    df = spark.createDataFrame([(3.0, 0.0), (7.0, 0.0)], "lat double, lon double")
    assert [r["region"] for r in classify_boxes(df, "lat", "lon", rules).collect()] == ["b", "a"]


def test_paste_strip_recode_levels(spark):
    df = spark.createDataFrame([("Calanoida", None), (None, None), ("Cope_UnID_UnID", "Adult")], "a string, b string")
    assert [r[0] for r in df.select(paste("a", "b")).collect()] == ["Calanoida NA", "NA NA", "Cope_UnID_UnID Adult"]
    assert [r[0] for r in df.select(strip_token("a", "_UnID")).collect()] == ["Calanoida", None, "Cope"]
    assert [r[0] for r in df.select(recode("a", {"Calanoida": "Cal"})).collect()] == ["Cal", None, "Cope_UnID_UnID"]
    levels = as_levels(df, "b", ["Juvenile", "Adult"], ["juv", "ad"], out="stage").collect()
    assert [(r["stage"], r["stage_ord"]) for r in levels] == [(None, None), (None, None), ("ad", 2)]


def test_zero_effort_gives_null(spark):
    df = spark.createDataFrame([(4.0, 2, 3, 2.0), (4.0, 0, 3, 2.0), (4.0, 2, 3, 0.0), (None, 2, 3, 2.0)], "n double, c int, d int, v double")
    assert [r[0] for r in df.select(cpue("n", "c", "d", "v")).collect()] == [3.0, None, None, None]


def test_filters_and_null(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "b")], "k int, v string")
    assert [r[0] for r in rows(df.filter(not_in("v", ["a"])), "k")] == [2, 3, 4]
    assert [r[0] for r in rows(df.filter(F.col("v") != "a"), "k")] == [3, 4]
    assert [r[0] for r in rows(df.filter(is_present("v")), "k")] == [1, 4]
    assert [r[0] for r in rows(complete_cases(df, ["v"]), "k")] == [1, 3, 4]
    assert [r[0] for r in rows(df.filter(between_open("k", 1, 4)), "k")] == [2, 3]
    changed = override(df, "v", F.col("v") == "a", "z")
    assert rows(changed, "k", "v") == [(1, "z"), (2, None), (3, ""), (4, "b")]


def test_strict_and_skipping_aggregates(spark, rows):
    df = spark.createDataFrame([("x", 1.0), ("x", None), ("y", 2.0), ("z", None)], "g string, v double")
    got = df.groupBy("g").agg(sum_of("v", False).alias("a"), sum_of("v", True).alias("b"), mean_of("v", False).alias("c"),
                              mean_of("v", True).alias("d"), n_distinct("v").alias("e"))
    assert rows(got) == [("x", None, 1.0, None, 1.0, 2), ("y", 2.0, 2.0, 2.0, 2.0, 1), ("z", None, 0.0, None, None, 1)]


def test_season_and_relative(spark):
    months = spark.createDataFrame([(m,) for m in (1, 3, 8, 12, None)], "m int")
    assert [r[0] for r in months.select(season_of("m")).collect()] == ["winter", "spring", "summer", "fall", None]
    df = relative_to_mean(spark.createDataFrame([(1.0,), (3.0,)], "x double"), "x")
    assert [(r["relative"], r["relative_range"]) for r in df.collect()] == [(0.6, 2.0), (1.6, 2.0)]
    assert lookup_df(spark, {1: "a"}, "month", "season").columns == ["month", "season"]


def test_natural_join_matches_null_and_fans_out(spark, rows):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(1, 10), (1, 11), (None, 12), (3, 13)], "k int, r int")
    assert rows(natural_join(left, right)) == [(1, "a", 10), (1, "a", 11), (None, "b", 12)]
    assert rows(natural_join(left, right, na_matches=False)) == [(1, "a", 10), (1, "a", 11)]
    assert rows(natural_join(left, right, "left")) == [(1, "a", 10), (1, "a", 11), (2, "c", None), (None, "b", 12)]
    assert rows(natural_join(left, right, "right")) == [(1, "a", 10), (1, "a", 11), (3, None, 13), (None, "b", 12)]
    assert rows(natural_join(left, right, "left_anti")) == [(2, "c")]
    assert rows(natural_join(left, right, "full"), "k") == [(1,), (1,), (2,), (3,), (None,)]
    assert rows(keep_keys(left, right, "k"), "l") == [("a",), ("b",)]
    assert rows(drop_keys(left, right, "k"), "l") == [("c",)]
    with pytest.raises(ValueError):
        natural_join(left, right.withColumnRenamed("k", "other"))


def test_natural_join_keeps_clashing_columns_apart(spark):
    left = spark.createDataFrame([(1, "a")], "k int, v string")
    right = spark.createDataFrame([(1, "b"), (1, "b")], "k int, v string")
    assert natural_join(left, right, by=["k"]).collect()[0].asDict() == {"k": 1, "v": "a", "v_right": "b"}
    assert natural_join(left, right, by=["k"], distinct_keys=True).count() == 1


def test_join_audit_finds_planted_faults(spark, rows):
    catch = spark.createDataFrame([("Acartia", "Acartia"), ("Bosmina", "Bosmina"), (None, "x")], "taxon string, tax2 string")
    cross = spark.createDataFrame([("Acartia", "Pseudo"), ("Acartia", "Pseudo"), ("Daphnia", "Daphnia")], "taxon string, tax2 string")
    assert rows(join_audit(catch, cross, ["taxon"], compare=["tax2"])) == [
        ("conflict:tax2", "Acartia", 2), ("duplicate_right", "Acartia", 2),
        ("unmatched_left", "Bosmina", 1), ("unmatched_left", "NA", 1), ("unmatched_right", "Daphnia", 1),
    ]


def test_expand_and_balanced(spark, rows):
    df = spark.createDataFrame(
        [("A", 3, "x", 1.0), ("A", 3, "y", 2.0), ("B", 3, "x", 3.0), ("B", 4, "x", 4.0), (None, 4, "x", 5.0), (None, 4, "y", 6.0)],
        "site string, month int, survey string, v double")
    assert expand(df, ["site", "month", "survey"]).count() == 3 * 2 * 2
    assert rows(balanced(df, ["site", "month"], "survey"), "v") == [(1.0,), (2.0,), (5.0,), (6.0,)]


def test_station_matching_over_several_columns(spark, rows):
    catch = spark.createDataFrame([("10", 1.0), ("20", 2.0)], "station string, cpue double")
    stations = spark.createDataFrame([("A", 10, "20"), ("B", None, "10")], "site string, code int, name string")
    assert rows(match_stations(catch, stations, ["code", "name"]), "site", "matched_by", "station") == [
        ("A", "code", "10"), ("A", "name", "20"), ("B", "name", "10")]


def test_effort_uses_highest_cell_and_all_counts(spark, rows):
    counts = spark.createDataFrame(
        [("s1", 2, 10.0, "a", 1, 3.0), ("s1", 2, 10.0, "a", 2, 5.0), ("s1", 2, 10.0, "b", 4, 8.0),
         ("s2", 1, 5.0, "a", 2, None), ("s2", 1, 5.0, "b", 2, 4.0), ("s3", 1, 0.0, "a", 1, 7.0)],
        "sample_id string, dilution int, volume double, taxon string, cell_number int, n_count double")
    got = agg.slides_to_cpue(counts, keys=["sample_id", "dilution", "taxon", "volume"])
    assert rows(got, "sample_id", "taxon", "tot_count", "tot_cells", "tot_count_all", "cpue") == [
        ("s1", "a", 8.0, 4, 16.0, 0.4), ("s1", "b", 8.0, 4, 16.0, 0.4),
        ("s2", "a", None, 2, None, None), ("s2", "b", 4.0, 2, None, 0.4), ("s3", "a", 7.0, 1, 7.0, None)]


def test_level_means_and_shares(spark, rows):
    df = spark.createDataFrame([("s1", "A", 1.0), ("s1", "A", 3.0), ("s2", "A", 6.0), ("s3", "B", 2.0)], "s string, g string, v double")
    assert rows(agg.mean_of_totals(df, ["s", "g"], ["g"], "v")) == [("A", 5.0, 2), ("B", 2.0, 1)]
    assert rows(agg.cascade_mean(df, [["s", "g"], ["g"]], "v")) == [("A", 4.0), ("B", 2.0)]
    assert rows(agg.mean_sd_se(df, ["g"], "v", se_mode="n"), "g", "n") == [("A", 3), ("B", 1)]
    assert agg.mean_sd_se(df, ["g"], "v").filter("g = 'B'").first()["sd"] is None
    assert rows(agg.share_of_total(df, ["g"], "v")) == [("A", 10.0, 10 / 12), ("B", 2.0, 2 / 12)]
    assert rows(agg.lump_rare(df, "g", "v", 0.2), "lumped") == [("A",), ("A",), ("A",), ("other",)]
    shares = agg.composition(df, ["s"], "g", "v")
    assert all(abs(r["t"] - 1) < 1e-12 for r in shares.groupBy("s").agg(F.sum("share").alias("t")).collect())
    bars = agg.stacked(df.withColumn("one", F.lit(1)), ["one"], "g", "v")
    assert rows(bars, "g", "lower", "upper") == [("A", 0.0, 10.0), ("B", 10.0, 12.0)]
    zero = df.unionByName(spark.createDataFrame([("s9", "Z", 0.0)], df.schema))
    assert agg.drop_zero_categories(zero, "g", "v").filter("g = 'Z'").count() == 0


def test_shapes_round_trip(spark, rows):
    long = spark.createDataFrame([("u", "a", 1.0), ("u", "a", 2.0), ("v", "b", 4.0)], "unit string, taxon string, x double")
    wide = community_matrix(long, ["unit"], "taxon", "x", ["a", "b"])
    assert rows(wide) == [("u", 3.0, 0.0), ("v", 0.0, 4.0)]
    assert rows(community_matrix(long, ["unit"], "taxon", "x", ["a", "b"], fill=None)) == [("u", 3.0, None), ("v", None, 4.0)]
    back = to_long(wide, ["unit"], columns_between(wide, "a", "b"), "taxon", "x")
    assert rows(back) == rows(community_long(long, "unit", "taxon", "x", zero_fill=True))
    assert rows(back) == rows(community_long(long, "unit", "taxon", "x", zero_fill=True, taxa=["a", "b"]))
    assert sort_columns(wide.select("b", "a", "unit"), first=["unit"]).columns == ["unit", "a", "b"]
    assert rows(stack(wide, wide.select("b", "a", "unit"))).count(("u", 3.0, 0.0)) == 2
    nulls = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert [r[0] for r in arrange(nulls, "k").collect()] == [1, 2, None]
    assert drop_prefix(spark.createDataFrame([(1, 2)], "SampleID int, x int"), "Sample").columns == ["x"]


def test_read_and_write_tables(spark, tmp_path, rows):
    from towline.sources import load_table, read_table, save_table, write_csv

    path = tmp_path / "catch.csv"
    path.write_text("Volume,Station,Date,CPUE\n10,A1,2018-03-05,2.5\nNA,,2018-13-40,x\n7,B,2018-04-01,\n")
    typed = read_table(spark, str(path), "Station string, Date date, CPUE double, Volume double", date_format="yyyy-MM-dd")
    assert rows(typed) == [("A1", datetime.date(2018, 3, 5), 2.5, 10.0), ("B", datetime.date(2018, 4, 1), None, 7.0), (None, None, None, None)]
    assert dict(read_table(spark, str(path)).dtypes)["Station"] == "string"
    with pytest.raises(ValueError):
        read_table(spark, str(path), "Missing string")
    save_table(typed, str(tmp_path / "t"), partition_by=["Station"])
    assert rows(load_table(spark, str(tmp_path / "t")), "Station", "Date", "CPUE", "Volume") == rows(typed)
    write_csv(typed, str(tmp_path / "c"))
    again = read_table(spark, str(tmp_path / "c"), "Station string, Date date, CPUE double, Volume double", date_format="yyyy-MM-dd")
    assert rows(again) == rows(typed)
    assert rows(read_table(spark, str(tmp_path / "t"), "CPUE string", format="parquet"), "CPUE") == [("2.5",), (None,), (None,)]


def test_inferred_scan_honours_every_null_token(spark, tmp_path):
    (tmp_path / "x.csv").write_text("n,v,d,t,e\n1,2.5,2020-01-02,a,\n-999,NA,NA,-999,NA\n,7,2021-03-04,b b,-999\n")
    from towline.sources import read_table

    got = read_table(spark, str(tmp_path / "x.csv"), null_values=("", "NA", "-999"))
    assert [t for _, t in got.dtypes] == ["int", "double", "date", "string", "string"]
    assert [tuple(r) for r in got.collect()] == [
        (1, 2.5, datetime.date(2020, 1, 2), "a", None), (None, None, None, None, None), (None, 7.0, datetime.date(2021, 3, 4), "b b", None)]
