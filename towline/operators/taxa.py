"""One regression per taxon over shared sampling units, cross-validation, and taxon associations.

Absent taxa are zeros: they add nothing to sums of x*y, so the long table is never filled for fitting.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .design import Design, design, factor, gram
from .reshape import community_long

BROADCAST_BYTES = 64 * 2**20


def _units(env: DataFrame, terms: Sequence, unit: str) -> tuple[DataFrame, Design]:
    """One row per unit with complete variables: `(unit, c0=1, c1, ...)`, written once."""
    spec = design(env, terms)
    columns = [F.lit(1.0), *[c.shifted() for c in spec.columns]]
    return cut(spec.complete(env).select(F.col(unit).alias("unit"), *[c.alias(f"c{k}") for k, c in enumerate(columns)])), spec


def _loads(long: DataFrame, units: DataFrame, unit: str, taxon: str, x: str) -> DataFrame:
    cells = long.groupBy(F.col(unit).alias("unit"), F.col(taxon).alias("taxon")).agg(F.sum(x).alias("y"))
    return cells.join(units, "unit")


def _dot(weights, columns) -> Column:
    total = F.lit(0.0)
    for w, c in zip(weights, columns):
        total = total + F.lit(float(w)) * c
    return total


def taxa_ols(long: DataFrame, env: DataFrame, terms: Sequence, unit: str = "unit", taxon: str = "taxon", x: str = "x") -> DataFrame:
    """Coefficient rows `(taxon, term, column, estimate, se)` of one least-squares fit per taxon."""
    units, spec = _units(env, terms, unit)
    p = len(spec.columns) + 1
    matrix = gram(units, [F.col(f"c{k}") for k in range(p)])[()]
    basis = factor(matrix)
    kept = basis.kept
    n = basis.n
    # Loadings on the orthonormal design columns: the fit is a product with the triangular factor.
    centred = [F.col(f"c{k + 1}") - F.lit(float(basis.means[k])) for k in kept]
    loadings = [
        F.sum(_dot(basis.inverse[: j + 1, j], centred[: j + 1]) * F.col("y")).alias(f"l{j}") for j in range(len(kept))
    ]
    sums = _loads(long, units, unit, taxon, x).groupBy("taxon").agg(
        F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), *loadings
    )
    mean = F.col("sy") / n
    explained = F.lit(0.0)
    for j in range(len(kept)):
        explained = explained + F.col(f"l{j}") * F.col(f"l{j}")
    rss = F.greatest(F.col("syy") - n * mean * mean - explained, F.lit(0.0))
    table = sums.withColumn("sigma2", F.try_divide(rss, F.lit(n - len(kept) - 1)))
    unscaled = basis.inverse @ basis.inverse.T
    anchors = np.array([spec.columns[k].anchor for k in kept])
    means = basis.means[kept] + anchors
    slopes = [_dot(basis.inverse[i, i:], [F.col(f"l{j}") for j in range(i, len(kept))]) for i in range(len(kept))]
    intercept = mean - _dot(means, slopes)
    entries = [("(intercept)", "(intercept)", intercept, 1.0 / n + means @ unscaled @ means)]
    place = {k: i for i, k in enumerate(kept)}
    for k, c in enumerate(spec.columns):
        known = k in place
        entries.append((c.term, c.name, slopes[place[k]] if known else F.lit(None).cast("double"),
                        unscaled[place[k], place[k]] if known else float("nan")))
    rows = F.array([
        F.struct(F.lit(t).alias("term"), F.lit(name).alias("column"), value.alias("estimate"),
                 F.when(value.isNotNull(), F.sqrt(F.lit(float(scale)) * F.col("sigma2"))).alias("se"))
        for t, name, value, scale in entries
    ])
    return table.select("taxon", F.explode(rows).alias("r")).select("taxon", "r.*")


def assign_folds(df: DataFrame, key: str, k: int, out: str = "fold") -> DataFrame:
    """Fold number from the key alone: whole numbers by remainder, anything else by hash."""
    if isinstance(df.schema[key].dataType, T.IntegralType):
        number = F.col(key)
    else:
        number = F.xxhash64(key)
    return df.withColumn(out, F.pmod(number, F.lit(k)).cast("int"))


def taxa_residuals(
    long: DataFrame, env: DataFrame, terms: Sequence, unit: str = "unit", taxon: str = "taxon", x: str = "x"
) -> DataFrame:
    """Residual of every unit and taxon from the taxon's regression on all units."""
    fitted = _predict(long, env, terms, 1, unit, taxon, x).drop("fold")
    return fitted.withColumn("resid", F.col("observed") - F.col("predicted"))


def cross_predict(
    long: DataFrame, env: DataFrame, terms: Sequence, k: int = 2, unit: str = "unit", taxon: str = "taxon", x: str = "x"
) -> DataFrame:
    """Out-of-fold prediction for every unit and taxon: `(unit, taxon, fold, observed, predicted)`.

    Training sums of a fold are the overall sums minus the fold's own, so all folds take one pass.
    """
    if k < 2:
        raise ValueError("cross-validation needs two folds or more")
    return _predict(long, env, terms, k, unit, taxon, x)


def _predict(long: DataFrame, env: DataFrame, terms: Sequence, k: int, unit: str, taxon: str, x: str) -> DataFrame:
    """Predictions from sums outside each fold; with one fold, from all sums."""
    units, spec = _units(env, terms, unit)
    units = assign_folds(units, "unit", k)
    p = len(spec.columns) + 1
    names = [F.col(f"c{j}") for j in range(p)]
    per_fold = gram(units, names, by=["fold"])
    overall = sum(per_fold.values())
    solvers = []
    for fold in range(k):
        training = overall - per_fold.get((fold,), np.zeros((p, p))) if k > 1 else overall
        basis = factor(training)
        chosen = [0, *[j + 1 for j in basis.kept]]
        inverse = np.zeros((p, p))
        inverse[np.ix_(chosen, chosen)] = np.linalg.inv(training[np.ix_(chosen, chosen)])
        solvers.append((fold, inverse.tolist()))
    loads = _loads(long, units, unit, taxon, x)
    own = loads.groupBy("taxon", "fold").agg(*[F.sum(names[j] * F.col("y")).alias(f"s{j}") for j in range(p)])
    # One row per taxon: sums over all folds, and those of each fold.
    by_taxon = own.groupBy("taxon").agg(
        F.array([F.sum(f"s{j}") for j in range(p)]).alias("overall"),
        F.map_from_entries(F.collect_list(F.struct("fold", F.array([F.col(f"s{j}") for j in range(p)])))).alias("own"),
    )
    solver = F.array([F.array([F.array([F.lit(float(v)) for v in row]) for row in rows]) for _, rows in solvers])
    coefficients = cut(
        by_taxon.select("taxon", "overall", "own", F.posexplode(solver).alias("fold", "inverse"))
        .withColumn("mine", F.try_element_at("own", F.col("fold")) if k > 1 else F.lit(None).cast("array<double>"))
        .withColumn("load", F.when(F.col("mine").isNull(), F.col("overall"))
                    .otherwise(F.zip_with("overall", "mine", lambda a, b: a - b)))
        .select("taxon", "fold", F.transform("inverse", lambda row: F.aggregate(
            F.zip_with(row, F.col("load"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("beta"))
    )
    # One row per unit carries its observed taxa in a map; its predictions come from its fold's coefficients.
    observed = community_long(loads, "unit", "taxon", "y", zero_fill=False)
    filled = units.join(
        observed.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("taxon", "y"))).alias("seen")), "unit", "left"
    )
    taxa = coefficients.agg(F.array_sort(F.collect_set("taxon"))).scalar()
    rows = filled.withColumn("taxon", F.explode(taxa)).withColumn(
        "observed", F.coalesce(F.try_element_at("seen", F.col("taxon")), F.lit(0.0))
    )
    fitted = F.lit(0.0)
    for j in range(p):
        fitted = fitted + names[j] * F.get("beta", F.lit(j))
    # Every unit and taxon meets its coefficients: broadcast them when they are proven small, else merge.
    small = coefficients.count() * p * 8 <= BROADCAST_BYTES
    matched = rows.join(F.broadcast(coefficients) if small else coefficients.hint("merge"), ["taxon", "fold"])
    return matched.select("unit", "taxon", "fold", "observed", fitted.alias("predicted"))


def fit_metrics(pred: DataFrame, by: Sequence[str] = ("taxon",)) -> DataFrame:
    """Root mean squared error and signed squared correlation of observed and predicted."""
    error = F.col("observed") - F.col("predicted")
    r = F.corr("observed", "predicted")
    return pred.groupBy(*by).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), (F.signum(r) * r * r).alias("r2"), F.count(F.lit(1)).alias("n")
    )


def taxon_association(
    resid: DataFrame, level: float = 0.5, unit: str = "unit", taxon: str = "taxon", value: str = "resid", block_taxa: int = 512, block_units: int = 4096
) -> DataFrame:
    """Correlation of residuals for every pair of taxa `(a, b, r, shown)`; `shown` is zero below the level.

    Taxa and units are hashed into blocks. A unit's residuals in one block of taxa are an array row; rows of two blocks of taxa
    meet by unit, and each group of a pair of blocks and a block of units gives the sums of its products. No task holds more than a tile,
    whatever the numbers of taxa and units. Pairs are correlated over the units that have both taxa.
    """
    cells = cut(resid.filter(F.col(value).isNotNull()).select(
        F.col(unit).alias("u"), F.col(taxon).cast("string").alias("t"), F.col(value).cast("double").alias("v")))
    sizes = cells.agg(F.approx_count_distinct("t"), F.approx_count_distinct("u")).first()
    taxon_blocks, unit_blocks = (max(1, -(-n // size)) for n, size in zip(sizes, (block_taxa, block_units)))
    packed = cells.withColumn("k", F.pmod(F.xxhash64("t"), F.lit(taxon_blocks)).cast("int")).groupBy("u", "k").agg(
        F.collect_list("t").alias("t"), F.collect_list("v").alias("v"))
    other = packed.select("u", F.col("k").alias("m"), F.col("t").alias("s"), F.col("v").alias("w"))
    tiles = packed.join(other.hint("merge"), "u").filter("k <= m").withColumn("c", F.pmod(F.xxhash64("u"), F.lit(unit_blocks)).cast("int"))

    def matrix(names: pd.Series, values: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        taxa, at = np.unique(np.concatenate(names.to_numpy()).astype(object), return_inverse=True)
        rows = np.repeat(np.arange(len(names)), names.map(len))
        x, present = np.zeros((len(names), len(taxa))), np.zeros((len(names), len(taxa)))
        x[rows, at], present[rows, at] = np.concatenate(values.to_numpy()), 1.0
        return taxa, x, present

    def products(tile: pd.DataFrame) -> pd.DataFrame:
        (a, x, p), (b, y, q) = matrix(tile["t"], tile["v"]), matrix(tile["s"], tile["w"])
        i, j = (v.ravel() for v in np.indices((len(a), len(b))))
        sums = {"ab": x.T @ y, "sa": x.T @ q, "sb": p.T @ y, "n": p.T @ q, "aa": (x * x).T @ q, "bb": p.T @ (y * y)}
        frame = pd.DataFrame({"a": a[i], "b": b[j]} | {name: m.ravel() for name, m in sums.items()})
        frame = frame[frame["n"] > 0]
        if tile["k"].iloc[0] == tile["m"].iloc[0]:
            return frame[frame["a"] <= frame["b"]]
        swap = frame["a"] > frame["b"]
        for left, right in (("a", "b"), ("sa", "sb"), ("aa", "bb")):
            frame.loc[swap, [left, right]] = frame.loc[swap, [right, left]].to_numpy()
        return frame

    schema = "a string, b string, ab double, sa double, sb double, n double, aa double, bb double"
    sums = tiles.groupBy("k", "m", "c").applyInPandas(products, schema).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("ab", "sa", "sb", "n", "aa", "bb")]
    )
    cov = F.col("ab") - F.col("sa") * F.col("sb") / F.col("n")
    spread = F.sqrt((F.col("aa") - F.col("sa") * F.col("sa") / F.col("n")) * (F.col("bb") - F.col("sb") * F.col("sb") / F.col("n")))
    r = F.try_divide(cov, spread)
    return sums.select("a", "b", r.alias("r"), F.when(F.abs(r) > level, r).otherwise(F.lit(0.0)).alias("shown"))
