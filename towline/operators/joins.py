"""Joins between survey tables and crosswalks.

No join carries a broadcast hint: Catalyst broadcasts a side whose size is below
`spark.sql.autoBroadcastJoinThreshold`, adaptive execution decides again from real sizes, and
everything larger is shuffled with skew handling. Crosswalks may therefore grow freely.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .reshape import expand_tables, to_long

log = logging.getLogger(__name__)


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in set(right.columns)]


def natural_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "inner",
    by: Sequence[str] | None = None,
    na_matches: bool = True,
    distinct_keys: bool = False,
) -> DataFrame:
    """Join on `by`, or on all shared columns, keeping duplicates on both sides.

    NULL keys match each other when `na_matches`. Shared columns that are not keys keep the left
    value under their name and the right value under `<name>_right`. `distinct_keys` first reduces
    the right side to distinct rows, so that exact duplicates in a crosswalk do not fan out.
    """
    keys = list(by) if by is not None else common_columns(left, right)
    if not keys:
        raise ValueError("no shared columns to join on")
    log.info("join on %s", keys)
    if distinct_keys:
        right = right.distinct()
    clash = [c for c in common_columns(left, right) if c not in keys]
    marked = right.withColumnsRenamed({k: f"__right_{k}" for k in keys} | {c: f"{c}_right" for c in clash})
    if na_matches:
        match = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    else:
        match = [F.col(k) == F.col(f"__right_{k}") for k in keys]
    joined = left.join(marked, reduce(lambda a, b: a & b, match), how)
    if how in ("left_semi", "left_anti"):
        return joined
    extra = [c for c in marked.columns if not c.startswith("__right_")]
    key_columns = {
        k: F.col(f"__right_{k}").alias(k) if how == "right"
        else F.coalesce(F.col(k), F.col(f"__right_{k}")).alias(k) if how in ("outer", "full")
        else F.col(k)
        for k in keys
    }
    rest = [F.col(c) for c in left.columns if c not in keys]
    return joined.select([key_columns[k] for k in keys] + rest + [F.col(c) for c in extra])


def keep_keys(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return natural_join(left, right, "left_semi", by=[key] if isinstance(key, str) else key)


def drop_keys(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in the other table: append an extract without duplicates."""
    return natural_join(left, right, "left_anti", by=[key] if isinstance(key, str) else key)


def expand(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All combinations of the observed values of several key columns. The table itself is read once, for its distinct keys."""
    keys = cut(df.select(*cols).distinct())
    grid = keys.select(cols[0]).distinct()
    for col in cols[1:]:
        grid = expand_tables(grid, keys.select(col).distinct())
    return grid


def join_audit(left: DataFrame, right: DataFrame, by: Sequence[str], compare: Sequence[str] = ()) -> DataFrame:
    """What a join would lose or multiply: `(kind, key, n)`.

    Kinds: `unmatched_left` and `unmatched_right` (n rows without partner), `duplicate_right`
    (n rows per repeated key, the fan-out) and `conflict:<column>` (n distinct values the two
    tables give one key).
    """
    keys = list(by)
    label = F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys])
    # One row per key and side first: everything below works on these counts.
    left_keys = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    right_keys = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def report(kind: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), label.alias("key"), F.col("n").cast("bigint").alias("n"))

    parts = [
        report("unmatched_left", natural_join(left_keys, right_keys.drop("n"), "left_anti", by=keys)),
        report("unmatched_right", natural_join(right_keys, left_keys.drop("n"), "left_anti", by=keys)),
        report("duplicate_right", right_keys.filter("n > 1")),
    ]
    for col in compare:
        seen = left.select(*keys, col).distinct().unionByName(right.select(*keys, col).distinct()).distinct()
        matched = natural_join(natural_join(seen, left_keys.drop("n"), "left_semi", by=keys),
                               right_keys.drop("n"), "left_semi", by=keys)
        clashes = matched.filter(F.col(col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        parts.append(report(f"conflict:{col}", clashes))
    return reduce(DataFrame.unionByName, parts)


def match_stations(
    catch: DataFrame, stations: DataFrame, cols: Sequence[str], site: str = "site", station: str = "station"
) -> DataFrame:
    """Attach the site to catch rows through any of several station-name columns.

    The crosswalk is made long once and joined once; a station listed under several columns or sites
    matches as often as it is listed.
    """
    text = stations.select(site, *[F.col(c).cast("string").alias(c) for c in cols])
    long = to_long(text, [site], cols, "matched_by", station).filter(F.col(station).isNotNull())
    return natural_join(catch.withColumn(station, F.col(station).cast("string")), long, "inner", by=[station])
