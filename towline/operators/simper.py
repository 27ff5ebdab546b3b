"""Which taxa make groups differ: contributions to between-group dissimilarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .blocks import STRIP_UNITS, Community, Side, Tile, community, copies_of, map_tiles, tiles_of
from .dissimilarity import group_labels
from .reshape import expand_tables


CELLS = 1 << 20  # cells of taxon and pair of groups held at once
FEW_GROUPS = 16  # so many are added up by a product of matrices


class _Groups:
    """The units of a block in order of their group: names of the groups, order, rank of a unit, group by rank and where each group begins."""

    def __init__(self, labels):
        self.names, code = np.unique(np.asarray(labels, dtype=object), return_inverse=True)
        self.order = np.argsort(code, kind="stable")
        self.code, self.rank = code[self.order], np.argsort(self.order, kind="stable")
        self.starts = np.flatnonzero(np.diff(self.code, prepend=-1))
        self.member = np.equal.outer(self.code, np.arange(len(self.names))).astype(float) if len(self.names) <= FEW_GROUPS else None

    def entries(self, side: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ranks and values of a taxon's entries in order, their groups, and where each begins."""
        at, x = side.entries(k)
        at = self.rank[at]
        order = np.argsort(at, kind="stable")
        at, x = at[order], x[order]
        groups, starts = np.unique(self.code[at], return_index=True)
        return at, x, groups, starts

    def added(self, rows: np.ndarray) -> np.ndarray:
        """Columns, one for each unit, added up by group."""
        return np.add.reduceat(rows, self.starts, axis=1) if self.member is None else rows @ self.member


def _full(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    out[at] = x
    return out


def _contribution_sums(profiles: DataFrame) -> DataFrame:
    """Per group pair and taxon: sum and sum of squares of |a - b| / (total_a + total_b) over the pairs.

    |a - b| is a + b less twice the lesser value, and its square a^2 + b^2 - 2 a b. So a value enters by its unit's weights towards the
    groups of the other block, and only taxa that both blocks hold need their pairs. Taxa are handled some at a time, which bounds the
    cells of groups held at once.
    """

    def kernel(tiles: Iterator[Tile]):
        for tile in tiles:
            a, b = _Groups(tile.row.label_a), _Groups(tile.row.label_b)
            names_a, names_b, na, nb = a.names, b.names, len(tile.a), len(tile.b)
            inverse = 1 / (tile.a.total[a.order][:, None] + tile.b.total[b.order][None, :])
            weight = inverse * np.multiply.outer(np.frombuffer(tile.row.copies_a)[a.order], np.frombuffer(tile.row.copies_b)[b.order])
            if tile.diagonal:
                weight = np.triu(weight, 1)
            square = weight * inverse
            by_b = [b.added(w) for w in (weight, square)]  # of a unit of a, towards groups of b
            by_a = [np.add.reduceat(w, a.starts, axis=0) for w in (weight, square)]
            shape = len(names_a), len(names_b)
            taxa = np.unique(np.concatenate([tile.a.taxa, tile.b.taxa]))
            in_a, in_b = ({t: k for k, t in enumerate(side.taxa)} for side in (tile.a, tile.b))
            step = max(1, CELLS // (shape[0] * shape[1]))
            for low in range(0, len(taxa), step):
                chunk = taxa[low : low + step]
                sums = np.zeros((2, len(chunk), *shape))
                for k, taxon in enumerate(chunk):
                    ka, kb = in_a.get(taxon), in_b.get(taxon)
                    if ka is not None:
                        i, x, g, a_starts = a.entries(tile.a, ka)
                        for m in (0, 1):
                            sums[m, k, g] += np.add.reduceat((x ** (m + 1))[:, None] * by_b[m][i], a_starts, axis=0)
                    if kb is not None:
                        j, y, h, b_starts = b.entries(tile.b, kb)
                        for m in (0, 1):
                            sums[m, k][:, h] += np.add.reduceat((y ** (m + 1)) * by_a[m][:, j], b_starts, axis=1)
                    if ka is None or kb is None:
                        continue
                    if 2 * len(i) >= na and 2 * len(j) >= nb:  # held by most units: no need to gather
                        x, y, least = _full(i, x, na), _full(j, y, nb), np.empty_like(by_b[0])
                        for first in range(0, na, STRIP_UNITS):
                            strip = slice(first, first + STRIP_UNITS)
                            both = np.minimum.outer(x[strip], y)
                            both *= weight[strip]
                            least[strip] = b.added(both)
                        cross = x[:, None] * (b.added(square * y) if b.member is None else square @ (b.member * y[:, None]))
                        for m, rows in ((0, least), (1, cross)):
                            sums[m, k] -= 2 * np.add.reduceat(rows, a.starts, axis=0)
                    else:
                        pairs = np.ix_(i, j)
                        for m, both in ((0, np.minimum.outer(x, y) * weight[pairs]), (1, np.multiply.outer(x, y) * square[pairs])):
                            sums[m, k][np.ix_(g, h)] -= 2 * np.add.reduceat(np.add.reduceat(both, a_starts, axis=0), b_starts, axis=1)
                taxon_at, a_at, b_at = np.nonzero(sums.any(0))
                left, right = names_a[a_at], names_b[b_at]
                swap, between = left > right, left != right
                yield {"g1": np.where(swap, right, left)[between], "g2": np.where(swap, left, right)[between], "taxon": chunk[taxon_at][between],
                       "c1": sums[0][taxon_at, a_at, b_at][between], "c2": sums[1][taxon_at, a_at, b_at][between]}

    tiles = tiles_of(copies_of(profiles, ("label",)))
    partial = map_tiles(tiles, kernel, "g1 string, g2 string, taxon string, c1 double, c2 double")
    return partial.groupBy("g1", "g2", "taxon").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))


def simper(
    long: DataFrame | Community, groups: DataFrame, group: str = "group", unit: str = "unit", taxon: str = "taxon", x: str = "x"
) -> DataFrame:
    """One row per group pair and taxon, ordered by contribution.

    `average` is the mean contribution to the dissimilarity of the two groups, `sd` its standard
    deviation over the pairs, `ratio` their quotient, `mean1` and `mean2` the taxon's mean in each
    group, and `cumulative` the running share of the overall dissimilarity.
    """
    com = long if isinstance(long, Community) else community(long, unit, taxon, x)
    profiles = com.profiles.join(group_labels(groups, group), "unit", "inner")
    sizes = profiles.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    totals = (
        profiles.select("label", F.explode(F.arrays_zip("taxa", "xs")).alias("cell"))
        .groupBy("label", F.col("cell.taxa").alias("taxon")).agg(F.sum("cell.xs").alias("total"))
    )
    # A taxon that both groups lack contributes nothing, whether or not a tile holds it.
    found = cut(_contribution_sums(profiles))
    sums = expand_tables(found.select("g1", "g2").distinct(), totals.select("taxon").distinct()).join(found, ["g1", "g2", "taxon"], "left").select(
        "g1", "g2", "taxon", F.coalesce("c1", F.lit(0.0)).alias("c1"), F.coalesce("c2", F.lit(0.0)).alias("c2"))

    def side(name: str, table: DataFrame, value: str, keys: list[str]) -> DataFrame:
        return table.withColumnsRenamed({"label": name, value: f"{value}_{name}"}).select(name, *keys, f"{value}_{name}")

    joined = sums
    for name in ("g1", "g2"):
        joined = joined.join(side(name, sizes, "n", []), name)
        joined = joined.join(side(name, totals, "total", ["taxon"]), [name, "taxon"], "left")
    pairs = F.col("n_g1") * F.col("n_g2")
    average = F.col("c1") / pairs
    # Sum of squared deviations over the pairs, kept from going below zero by rounding.
    spread = F.greatest(F.col("c2") - F.col("c1") * average, F.lit(0.0))
    table = joined.select(
        "g1", "g2", "taxon",
        average.alias("average"),
        F.sqrt(F.try_divide(spread, pairs - 1)).alias("sd"),
        (F.coalesce("total_g1", F.lit(0.0)) / F.col("n_g1")).alias("mean1"),
        (F.coalesce("total_g2", F.lit(0.0)) / F.col("n_g2")).alias("mean2"),
    )
    per_pair = Window.partitionBy("g1", "g2")
    ordered = per_pair.orderBy(F.desc("average"), "taxon").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumns({
        "ratio": F.try_divide("average", "sd"),
        "cumulative": F.try_divide(F.sum("average").over(ordered), F.sum("average").over(per_pair)),
    })
