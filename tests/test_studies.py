"""The three studies on small extracts, and the registered queries as a whole."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from towline.plans import studies
from towline.sources import load_table, save_table

D = datetime.date


@pytest.fixture(scope="module")
def stations_wide(spark):
    row = "site string, site2 string, shallowdeep string, ggdist int, sitetype string, region string, shore string, net string, fixed string"
    return spark.createDataFrame([
        ("Grizzly Bay", "G1", "Y", 60, "Tidal", "Suisun Bay", "GB-1", "602", "NZ1"),
        ("Grizzly Bay", "G1", "Y", 60, "Tidal", "Suisun Bay", "GB-1", "602", "NZ1"),
        ("Browns", "B1", "Y", 70, "Diked", "Confluence", "BR-1", "", None),
        ("Elsewhere", "E1", "Y", 80, "Muted", "Cache", "EL-1", None, None),
        ("Prospect", "P1", "N", 90, "Muted", "Cache", "PR-1", "720", "NZ9"),
    ], row)


@pytest.fixture(scope="module")
def crosswalk(spark):
    return spark.createDataFrame([
        ("Calanoid copepod", "Adult", "Acartia", "Calanoida", "Acartia"),
        ("Water flea", "Adult", "Bosmina", "Cladocera", "Bosmina"),
        ("NA", "Juvenile", "Acartia", "Calanoida", "Acartia"),
    ], "common_name string, lifestage string, taxname string, analy string, analy2 string")


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([
        ("GB-1", D(2018, 3, 5), "F1", 2, 10.0, "Calanoid copepod", 1, 4.0),
        ("GB-1", D(2018, 3, 5), "F1", 2, 10.0, "Calanoid copepod", 2, 6.0),
        ("GB-1", D(2018, 3, 5), "F1", 2, 10.0, "Water flea", 4, 8.0),
        ("BR-1", D(2016, 3, 5), "F0", 2, 10.0, "Water flea", 1, 8.0),
    ], "station string, date date, sample_id string, dilution int, volume double, common_name string, cell_number int, n_count double")


@pytest.fixture(scope="module")
def newer(spark):
    return spark.createDataFrame([
        ("GB-1", D(2018, 3, 5), "F1", "Water flea", 99.0, "Adult", "Cladocera", "Bosmina"),
        ("BR-1", D(2019, 4, 2), "F2", "Water flea", 3.0, "Adult", "Cladocera", "Bosmina"),
    ], "station string, date date, sample_id string, common_name string, cpue double, lifestage string, analy string, analy2 string")


def test_three_surveys_become_one_table(spark, stations_wide, crosswalk, counts, newer, rows):
    external = spark.createDataFrame([
        ("602", "T1", D(2017, 5, 1), 5.0, "Adult", "Acartia_UnID", "Acartia_UnID Adult"),
        ("602", "T2", D(2017, 5, 2), 7.0, "Juvenile", "Acartia", "Acartia Juvenile"),
        ("NZ1", "E1", D(2019, 6, 3), 1.0, "Adult", "Oddity", "Oddity Adult"),
        ("NZ1", "E2", D(2019, 7, 3), 1.0, "Adult", "Acartia", "Acartia Adult"),
    ], "station string, sample_id string, date date, cpue double, lifestage string, taxname string, taxlifestage string")
    assert studies.survey_stations(stations_wide, ["shore", "net", "fixed"]).filter("site = 'Grizzly Bay'").count() == 3
    catch = studies.three_survey_catch(stations_wide, external, crosswalk, counts, newer.drop("lifestage", "analy", "analy2"),
                                       ["shore", "net", "fixed"], "shore")
    assert rows(catch, "survey", "sample_id", "cpue", "analy_ls", "month2", "month2_ord") == [
        ("fixed", "E1", 1.0, None, "Jun", 4),
        ("net", "T1", 5.0, "Calanoids", "May", 3), ("net", "T2", 7.0, "Cala Juv", "May", 3),
        ("shore", "F1", 0.4, "Cladocera", "Mar", 1), ("shore", "F1", 0.5, "Calanoids", "Mar", 1),
        ("shore", "F2", 3.0, "Cladocera", "Apr", 2),
    ]
    shares = studies.three_survey_composition(catch)
    got = {(r["survey"], r["analy_ls"]): r["share"] for r in shares.collect()}
    assert got[("net", "Calanoids")] == pytest.approx(5 / 12) and got[("net", "Cala Juv")] == pytest.approx(7 / 12)
    per_bar = shares.groupBy("site", "month2", "survey").agg(F.sum("share").alias("t")).collect()
    assert all(abs(r["t"] - 1) < 1e-12 for r in per_bar) and len(per_bar) == 3


def test_long_term_catch_seasons_regions_and_biomass(spark, rows):
    schema = "source string, sample_id string, station string, volume double, month int, year int, lat double, lon double, sal double, taxname string, taxlifestage string, cpue double"
    catch = spark.createDataFrame([
        ("fixed", "a", "s", 1.0, 2, 2000, 38.0, -122.0, 2.0, "Acartia", "Acartia Adult", 9.0),
        ("fixed", "b", "s", 1.0, 3, 2000, 38.0, -122.0, 2.0, "Acartia", "Acartia Adult", 2.0),
        ("fixed", "b", "s", 1.0, 3, 2000, 38.0, -122.0, 2.0, "Oddity", "Oddity Adult", 4.0),
        ("fixed", "c", "s", 1.0, 4, 2000, 38.0, -122.0, 0.0, "Acartia", "Acartia Adult", 6.0),
        ("fixed", "d", "s", 1.0, 5, 2000, None, -122.0, 0.0, "Acartia", "Acartia Adult", 1.0),
    ], schema)
    taxa = spark.createDataFrame([("Acartia", "Acartia", "Calanoida")], "taxname string, tax2 string, tax3 string")
    long = studies.long_term_catch(catch, taxa)
    assert rows(long, "sample_id", "season", "region", "tax2") == [
        ("b", "spring", "Suisun", "Acartia"), ("b", "spring", "Suisun", None), ("c", "spring", "Suisun", "Acartia")]
    means = studies.seasonal_means(long)
    assert rows(means, "tax2", "cpue", "sal") == [("Acartia", 4.0, 1.0), (None, 4.0, 2.0)]
    assert rows(studies.salinity_composition(means), "tax2", "salbin", "share") == [
        ("Acartia", "(0,1]", 1.0), (None, "(1,2]", 1.0)]
    assert rows(studies.monthly_community(long, ["sample_id"]), "month", "tax2", "cpue", "sal") == [
        (3, "Acartia", 2.0, 2.0), (3, None, 4.0, 2.0), (4, "Acartia", 6.0, 0.0)]
    conversion = spark.createDataFrame([("Acartia Adult", 3.0)], "taxlifestage string, biomass double")
    assert rows(studies.biomass_means(catch, conversion), "month", "bpue") == [(2, 27.0), (3, 6.0), (4, 18.0), (5, 3.0)]


def test_spring_study_runs_as_two_jobs(spark, counts, newer, tmp_path, rows):
    codes = spark.createDataFrame([
        ("Calanoid copepod", "Adult", "Calanoida", "Acartia"), ("Water flea", "Adult", "Cladocera", "Bosmina"),
    ], "common_name string, lifestage string, analy string, analy2 string")
    save_table(studies.spring_own_catch(counts, codes, newer), str(tmp_path / "own"))
    own = load_table(spark, str(tmp_path / "own"))
    assert rows(own, "sample_id", "cpue") == [("F0", 1.6), ("F1", 0.4), ("F1", 0.5), ("F2", 3.0)]
    stations = spark.createDataFrame([
        ("Grizzly Bay", "G1", "Suisun Bay", "Muted", "shore", "GB-1", 60), ("Browns", "Decker", "Confluence", "Diked", "shore", "BR-1", 70),
        ("Browns", "Decker", "Confluence", "Channel", "fixed", "NZ1", 70),
    ], "site string, site2 string, region string, sitetype string, survey string, station string, ggdist int")
    external = spark.createDataFrame([
        ("NZ1", "E1", D(2018, 4, 3), 2.0, "Adult", "Calanoida", "Acartia"), ("NZ1", "E2", D(2018, 4, 3), 2.0, "Adult", "NA", "NA"),
    ], "station string, sample_id string, date date, cpue double, lifestage string, analy string, analy2 string")
    catch = studies.spring_catch(own, stations, external, "shore")
    assert rows(catch, "sample_id", "sitetype", "analy_ls") == [
        ("E1", "Channel", "Calanoida Adult"), ("F1", "Muted", "Calanoida Adult"), ("F1", "Muted", "Cladocera Adult"),
        ("F2", "Tidal", "Cladocera Adult")]
    assert {r["group"] for r in studies.spring_lumped(catch).collect()} == {"Calanoida Adult", "Cladocera Adult"}
    shares = studies.spring_composition(catch)
    assert rows(shares, "sitetype", "analy_ls", "n") == [
        ("Channel", "Calanoida Adult", 1), ("Muted", "Calanoida Adult", 1), ("Muted", "Cladocera Adult", 1), ("Tidal", "Cladocera Adult", 1)]


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    assert all("SELECT" in sql for sql in oracles.values())


@pytest.mark.parametrize("name", ["percent_composition", "natural_left_join", "simper", "cross_prediction"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("benchmark tables absent")
    connection = duckdb.connect()
    for file in os.listdir(sf):
        connection.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf}/{file}'")
    answer = connection.sql(entry.oracle_sql()[name])
    result = entry.queries()[name](spark, sf)
    order = sorted(result.columns)
    assert order == sorted(answer.columns)
    left = sorted((tuple(r[c] for c in order) for r in result.collect()), key=repr)
    right = sorted((tuple(row[answer.columns.index(c)] for c in order) for row in answer.fetchall()), key=repr)
    assert left == right


def test_entry_has_rows(spark):
    result = entry.entry(spark)
    assert result.columns == ["region", "month", "taxon", "total", "share"] and result.count() > 0


def test_raw_lines_come_in_tasks_of_bounded_size(spark, monkeypatch):
    """The rows of a task do not grow with the table, and the results are those of few large tasks."""
    from towline.plans import testviews

    folder = "/root/testdata/sf0.001"
    names = ["sample_sizes", "mean_of_totals", "community_matrix", "relative_abundance", "cascade_mean"]
    before = {n: sorted(map(repr, entry.queries()[n](spark, folder).collect())) for n in names}
    monkeypatch.setattr(testviews, "TASK_ROWS", 100)
    rows = [r["count"] for r in testviews.raw(spark, folder).groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) > 40 and max(rows) <= 300
    for n in names:
        assert sorted(map(repr, entry.queries()[n](spark, folder).collect())) == before[n]
