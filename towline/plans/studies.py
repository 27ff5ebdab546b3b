"""The three studies end to end, from survey extracts to composition and community tables.

Each function takes tables with the column names used here and returns a lazy DataFrame, so a study is
one plan until its result is written or tested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_levels, classify_boxes, cut, is_present, override, paste, strip_token
from ..operators.aggregate import (
    composition, lump_rare, mean_of_totals, n_samples, slides_to_cpue, to_biomass,
)
from ..operators.joins import drop_keys, natural_join
from ..operators.reshape import stack, to_long
from ..sources import season_of
from .fixed import (
    CATCH_GROUP_LABELS, MONTH_LABELS, RARE_NAME, RARE_SHARE, REGION_BOXES, SALINITY_BREAKS, SPRING_MONTHS,
    SPRING_REGIONS, STUDY_SITES, STUDY_YEARS, UNIDENTIFIED_TOKEN,
)

CATCH_COLUMNS = ["site", "survey", "station", "ggdist", "sample_id", "date", "cpue", "lifestage", "taxname", "analy", "analy2"]


def survey_stations(wide: DataFrame, surveys: Sequence[str], sites: Sequence[str] = STUDY_SITES) -> DataFrame:
    """Station crosswalk in long form: shallow sites with a station code, duplicates removed."""
    keep = ["site", "site2", "shallowdeep", "ggdist", "sitetype", "region"]
    text = wide.select(*[c for c in keep if c in wide.columns], *[F.col(s).cast("string").alias(s) for s in surveys])
    placed = as_levels(text, "site", list(sites))
    ids = [c for c in placed.columns if c not in surveys]
    return to_long(placed, ids, surveys, "survey", "station").distinct().filter(
        (F.col("shallowdeep") == "Y") & is_present("station")
    )


def external_catch(stations: DataFrame, external: DataFrame, crosswalk: DataFrame, own_survey: str) -> DataFrame:
    """Catch of the other surveys at the chosen stations, with analysis classes."""
    others = stations.filter(F.col("survey") != own_survey)
    at_sites = natural_join(others, external, "left", by=["station"])
    cleaned = at_sites.withColumns({c: strip_token(c, UNIDENTIFIED_TOKEN) for c in ("taxname", "taxlifestage")})
    classes = crosswalk.select(paste("taxname", "lifestage").alias("taxlifestage"), "analy", "analy2").distinct()
    return natural_join(classes, cleaned, "right", by=["taxlifestage"]).select(CATCH_COLUMNS)


def own_catch(stations: DataFrame, catch: DataFrame, crosswalk: DataFrame, own_survey: str) -> DataFrame:
    """Catch counted by the own survey, with analysis classes, at its stations."""
    classes = crosswalk.filter(F.col("common_name") != "NA").select("common_name", "lifestage", "taxname", "analy", "analy2")
    classified = natural_join(catch.select("station", "date", "sample_id", "common_name", "cpue"), classes, "inner",
                              by=["common_name"])
    own = stations.filter(F.col("survey") == own_survey)
    return natural_join(own, classified, "left", by=["station"]).select(CATCH_COLUMNS)


def three_survey_catch(
    stations_wide: DataFrame, external: DataFrame, crosswalk: DataFrame, counts: DataFrame, newer: DataFrame,
    surveys: Sequence[str], own_survey: str,
) -> DataFrame:
    """All surveys as one long catch table for the spring months, with display labels.

    `surveys` names the station-code columns of the crosswalk, one per survey; `own_survey` is the one
    whose slides are in `counts` and `newer`.
    """
    stations = survey_stations(stations_wide, surveys)
    counted = slides_to_cpue(counts, keys=["station", "date", "sample_id", "dilution", "common_name", "volume"])
    first = own_catch(stations, counted, crosswalk, own_survey)
    later = drop_keys(own_catch(stations, newer, crosswalk, own_survey), first.select("sample_id"), "sample_id")
    everything = stack(first, external_catch(stations, external, crosswalk, own_survey), later)
    dated = everything.withColumns({
        "month": F.month("date"), "year": F.year("date"), "analy_ls": paste("analy", "lifestage"),
    }).filter(F.col("month").isin(SPRING_MONTHS) & F.col("year").isin(STUDY_YEARS))
    labelled = as_levels(dated, "analy_ls", list(CATCH_GROUP_LABELS), list(CATCH_GROUP_LABELS.values()))
    return as_levels(labelled, "month", list(MONTH_LABELS), list(MONTH_LABELS.values()), out="month2")


def three_survey_composition(catch: DataFrame) -> DataFrame:
    """Mean catch per group, site, month, survey and year, and each group's share of its bar."""
    strata = ["analy_ls", "analy", "lifestage", "site", "month", "month2", "survey", "year"]
    means = mean_of_totals(catch, ["sample_id", *strata, "ggdist"], strata, "cpue", out="cpue", also_mean=["ggdist"])
    return composition(means.filter(F.col("analy_ls").isNotNull()), ["site", "month2", "survey"], "analy_ls", "cpue")


def long_term_catch(catch: DataFrame, taxa: DataFrame) -> DataFrame:
    """Integrated catch from March on, with season, region and taxon groups; unplaced rows are dropped."""
    seasonal = catch.withColumn("season", season_of("month")).filter("month > 2 AND season IS NOT NULL")
    placed = classify_boxes(seasonal, "lat", "lon", REGION_BOXES, out="region").filter(is_present("lat"))
    return natural_join(placed, taxa, "left", by=["taxname"])


def seasonal_means(catch: DataFrame) -> DataFrame:
    """Mean catch and salinity per season, year, taxon group and region."""
    return catch.groupBy("season", "year", "tax2", "tax3", "region").agg(F.avg("cpue").alias("cpue"), F.avg("sal").alias("sal"))


def salinity_composition(means: DataFrame) -> DataFrame:
    """Share of each taxon group per salinity bin, season and region."""
    binned = means.withColumn("salbin", cut("sal", SALINITY_BREAKS))
    by_bin = binned.groupBy("season", "tax2", "tax3", "salbin", "region").agg(F.avg("cpue").alias("cpue"))
    return composition(by_bin, ["season", "region", "salbin"], "tax2", "cpue")


def monthly_community(catch: DataFrame, sample_keys: Sequence[str]) -> DataFrame:
    """Mean of sample totals per month, year, region, season and taxon group, with mean salinity."""
    strata = ["month", "year", "region", "season"]
    keys = list(dict.fromkeys([*sample_keys, *strata, "sal", "tax2"]))
    totals = catch.groupBy(*keys).agg(F.sum("cpue").alias("cpue"))
    return totals.groupBy(*strata, "tax2").agg(F.avg("cpue").alias("cpue"), F.avg("sal").alias("sal"))


def biomass_means(catch: DataFrame, conversion: DataFrame) -> DataFrame:
    """Mean biomass per month, year and source, over sample totals."""
    weighed = to_biomass(catch, conversion, ["taxlifestage"], "biomass")
    strata = ["month", "year", "source"]
    return mean_of_totals(weighed, [*strata, "sample_id", "station", "volume"], strata, "bpue", skip_null=False, out="bpue")


def spring_own_catch(counts: DataFrame, codes: DataFrame, newer: DataFrame) -> DataFrame:
    """First job of the spring study: own catch from counts and from a newer extract, to be saved."""
    counted = slides_to_cpue(counts, keys=["station", "date", "sample_id", "dilution", "common_name", "volume"])
    classified = natural_join(counted, codes, "inner", by=["common_name"])
    columns = ["station", "date", "sample_id", "common_name", "cpue", "lifestage", "analy", "analy2"]
    return stack(drop_keys(newer.select(columns), classified.select("sample_id"), "sample_id"), classified.select(columns))


def spring_catch(
    own: DataFrame, stations: DataFrame, external: DataFrame, own_survey: str, months: Sequence[int] = (3, 4)
) -> DataFrame:
    """Second job: own and external catch at the long station list, with site type changes and labels."""
    place = ["site", "site2", "region", "sitetype", "survey", "station", "ggdist"]
    values = ["sample_id", "date", "cpue", "lifestage", "analy", "analy2"]
    mine = natural_join(stations.filter(F.col("survey") == own_survey), own, "left", by=["station"]).select(*place, *values)
    mine = as_levels(mine, "region", SPRING_REGIONS).drop("region_ord")
    theirs = natural_join(stations.filter(F.col("survey") != own_survey), external, "left", by=["station"]).select(*place, *values)
    both = stack(mine, theirs).withColumns({"year": F.year("date"), "month": F.month("date")})
    both = both.filter(F.col("year").isin(STUDY_YEARS) & F.col("month").isin(list(months)))
    # The one site whose type changed, and the last year of its old type.
    changed = override(both, "sitetype", (F.col("site2") == "Decker") & (F.col("year") > 2018), "Tidal")
    return changed.withColumn("analy_ls", paste("analy", "lifestage")).filter(F.col("analy") != "NA")


def spring_lumped(catch: DataFrame) -> DataFrame:
    """Rare groups renamed."""
    return lump_rare(catch, "analy_ls", "cpue", RARE_SHARE, RARE_NAME, out="group")


def spring_composition(catch: DataFrame, group: str = "analy_ls") -> DataFrame:
    """Mean catch per group, site type and region over site means, the shares, and the number of samples."""
    sites = [group, "analy", "survey", "lifestage", "site2", "sitetype", "region", "year"]
    means = mean_of_totals(catch, ["sample_id", *sites, "ggdist"], sites, "cpue", out="cpue", also_mean=["ggdist"])
    wider = means.groupBy(group, "analy", "survey", "lifestage", "sitetype", "region").agg(F.avg("cpue").alias("cpue"))
    shares = composition(wider, ["sitetype", "region"], group, "cpue")
    return natural_join(shares, n_samples(catch, ["region", "sitetype"], "sample_id"), "inner", by=["region", "sitetype"])
