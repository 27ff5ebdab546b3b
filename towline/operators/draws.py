"""Tables of draws `(chain, iter, param, value)`: summaries and convergence."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .regression import f_quantile

BUCKET = 65536


def renumber_iterations(draws: DataFrame) -> DataFrame:
    """Number the iterations of each chain and parameter 0, 1, 2, ... in order.

    Ranks come from bounded stretches of the iteration number plus the count before them, so a long
    chain is never one sort in one task.
    """
    bucket = F.floor(F.col("iter") / BUCKET)
    keyed = draws.withColumn("__bucket", bucket)
    counts = keyed.groupBy("chain", "param", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("chain", "param").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("chain", "param", "__bucket").orderBy("iter")
    ranked = keyed.withColumn("__rank", F.row_number().over(inside) - 1).join(offsets, ["chain", "param", "__bucket"])
    return ranked.select("chain", (F.col("__before") + F.col("__rank")).cast("bigint").alias("iter"), "param", "value")


def draws_summary(draws: DataFrame) -> DataFrame:
    """Mean and the shares of draws above and below zero, per parameter."""
    return draws.groupBy("param").agg(
        F.avg("value").alias("mean"),
        F.avg((F.col("value") > 0).cast("double")).alias("support"),
        F.avg((F.col("value") < 0).cast("double")).alias("support_negative"),
    )


def supported(summary: DataFrame, level: float = 0.95) -> DataFrame:
    """Means that enough draws support in either direction; all others become zero."""
    good = (F.col("support") > level) | (F.col("support_negative") > level)
    return summary.withColumn("supported", F.when(good, F.col("mean")).otherwise(F.lit(0.0)))


def _f_quantile(p: float, df1: Column, df2: Column) -> Column:
    """Quantiles of the F distribution, one per row."""

    @F.pandas_udf("double")
    def solve(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([f_quantile(p, a, b) if a > 0 and b > 0 else math.nan for a, b in zip(one, two)], dtype=float)

    return F.nanvl(solve(df1.cast("double"), df2.cast("double")), F.lit(None))


def psrf(draws: DataFrame, adjust: bool = True, confidence: float | None = None) -> DataFrame:
    """Scale-reduction factor per parameter: pooled against within-chain variance.

    `adjust` applies the sampling-variability correction of Gelman and Rubin (1992). Chains are one
    aggregate each; their lengths should agree, and their mean length is used. With `confidence`, column `upper` is the upper
    limit of the factor at that confidence, from the F distribution of the ratio of variances between and within chains. It
    is NULL with fewer than two chains, and where all chains vary alike, as the degrees of freedom are then unknown.
    """
    chains = draws.groupBy("param", "chain").agg(
        F.avg("value").alias("m"), F.var_samp("value").alias("s2"), F.count(F.lit(1)).cast("double").alias("n")
    )
    m2 = F.col("m") * F.col("m")
    by_param = chains.groupBy("param").agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.avg("n").alias("n"), F.avg("s2").alias("w"), F.avg("m").alias("mu"),
        F.var_samp("m").alias("between"), F.var_samp("s2").alias("var_s2"),
        F.covar_samp("s2", "m").alias("cov_m"), F.covar_samp("s2", m2).alias("cov_m2"),
    )
    n, k, w = F.col("n"), F.col("k"), F.col("w")
    b = n * F.col("between")
    fixed, random = (n - 1) / n, (1 + 1 / k) * F.try_divide(b, n * w)
    pooled = (n - 1) / n * w + (1 + 1 / k) * b / n
    cov_wb = n / k * (F.col("cov_m2") - 2 * F.col("mu") * F.col("cov_m"))
    var_pooled = (
        (n - 1) * (n - 1) * F.col("var_s2") / k + (1 + 1 / k) * (1 + 1 / k) * 2 * b * b / (k - 1)
        + 2 * (n - 1) * (1 + 1 / k) * cov_wb
    ) / (n * n)
    df = F.try_divide(2 * pooled * pooled, var_pooled)
    correction = (df + 3) / (df + 1) if adjust else F.lit(1.0)
    result = [F.col("param"), F.sqrt(correction * F.try_divide(pooled, w)).alias("psrf")]
    if confidence is not None:
        within = F.try_divide(2 * w * w, F.col("var_s2") / k)
        limit = _f_quantile((1 + confidence) / 2, k - 1, within)
        result.append(F.sqrt(correction * (fixed + limit * random)).alias("upper"))
    return by_param.select(*result)


def autocovariance_sums(centred: DataFrame, low: int, high: int | Column) -> DataFrame:
    """(chain, param, lag, s): sums of v times the v that is `lag` iterations later, for lags from `low` up to below `high`.

    Draws are cut into stretches of BUCKET iterations, and lags into ranges of at most as many. Each stretch meets the draws
    that lie a range's lags behind it, which are those of at most two stretches, so a draw is sent three times for each range and
    a task holds two stretches however long the chain is. Long ranges are multiplied by fast Fourier transforms.
    """
    top = (high if isinstance(high, Column) else F.lit(high)).cast("bigint")
    ranges = F.explode(F.sequence(F.lit(low).cast("bigint"), top - 1, F.lit(BUCKET).cast("bigint"))).alias("from")
    cut_up = centred.filter(top > low).select("chain", "param", "iter", F.coalesce("v", F.lit(0.0)).alias("v"), ranges, top.alias("top"))
    cut_up = cut_up.withColumn("lags", F.least(F.col("top") - F.col("from"), F.lit(BUCKET)))
    block = F.floor(F.col("iter") / BUCKET)
    early = F.struct(F.lit(True).alias("early"), block.alias("block"), (F.col("iter") - block * BUCKET).alias("at"))
    reach = F.col("iter") - F.col("from")
    to = lambda b: F.struct(F.lit(False).alias("early"), b.alias("block"), (reach - b * BUCKET).alias("at"))
    last, first = F.floor(reach / BUCKET), F.floor((reach - F.col("lags") + 1) / BUCKET)
    roles = F.array_compact(F.array(early, to(last), F.when(first < last, to(first))))
    dealt = cut_up.select("chain", "param", "from", "lags", "v", F.explode(roles).alias("r")).select(
        "chain", "param", "from", "lags", "v", "r.early", "r.block", "r.at")
    kinds = ", ".join(f"{c} {centred.schema[c].dataType.simpleString()}" for c in ("chain", "param"))

    def products(key, rows):
        lags = int(rows["lags"].iloc[0])
        early, at, v = rows["early"].to_numpy(bool), rows["at"].to_numpy(), rows["v"].to_numpy(float)
        a, b = np.zeros(BUCKET), np.zeros(BUCKET + lags - 1)
        a[at[early]], b[at[~early]] = v[early], v[~early]
        if not early.any() or early.all():
            sums = np.zeros(lags)
        elif lags <= 128:
            sums = np.array([a @ b[k : k + BUCKET] for k in range(lags)])
        else:
            size = 1 << int(2 * BUCKET - 1).bit_length()
            sums = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)[:lags]
        return pd.DataFrame({"chain": [key[0]] * lags, "param": [key[1]] * lags, "lag": key[2] + np.arange(lags), "s": sums})

    parts = dealt.groupBy("chain", "param", "from", "block").applyInPandas(products, f"{kinds}, lag bigint, s double")
    return parts.groupBy("chain", "param", "lag").agg(F.sum("s").alias("s"))


def _centred(draws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moments of each chain and parameter, written so that their size is known, and the draws about their mean."""
    draws = cut(draws)
    moments = cut(draws.groupBy("chain", "param").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")))
    return moments, cut(draws.join(moments, ["chain", "param"]).select("chain", "param", "iter", "n", (F.col("value") - F.col("m")).alias("v")))


def ess(draws: DataFrame, first_lags: int = 32) -> DataFrame:
    """Effective sample size per parameter, by the initial positive sequence (Geyer 1992), summed over chains.

    Iterations must be consecutive (see `renumber_iterations`). Lags are taken in stages, the first of `first_lags` and each
    twice as long as the one before, for the chains whose sequence is still positive: there is no greatest lag but the chain's length.
    """
    moments, centred = _centred(draws)
    open_, low, step, gammas = moments.select("chain", "param", "n"), 0, first_lags + first_lags % 2, None
    while not open_.isEmpty():
        own = centred.join(open_.select("chain", "param"), ["chain", "param"], "left_semi").filter(F.col("n") > low)
        sums = autocovariance_sums(own, low, F.least(F.lit(low + step), F.col("n")))
        products = sums.join(moments, ["chain", "param"]).withColumn("c", F.col("s") / F.col("n"))
        # Sums of neighbouring autocovariances.
        part = cut(products.withColumn("t", F.floor(F.col("lag") / 2)).groupBy("chain", "param", "t").agg(
            F.sum("c").alias("gamma"), F.max(F.when(F.col("lag") == 0, F.col("c"))).alias("c0"), F.first("n").alias("n"), F.count(F.lit(1)).alias("lags"),
        ).filter("lags = 2").drop("lags"))
        gammas = part if gammas is None else gammas.union(part)
        low, step = low + step, 2 * step
        ended = part.filter("gamma <= 0").select("chain", "param").distinct()
        open_ = cut(open_.filter(F.col("n") > low).join(ended, ["chain", "param"], "left_anti"))
    if gammas is None:
        return moments.select("param", F.lit(None).cast("double").alias("ess"), "n")
    # Up to the first sum that is not positive, made non-increasing.
    order = Window.partitionBy("chain", "param").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    lowest = gammas.withColumns({"least": F.min("gamma").over(order), "c0": F.max("c0").over(order)})
    initial = lowest.filter("least > 0").groupBy("chain", "param").agg(
        F.sum("least").alias("total"), F.max("c0").alias("c0"), F.first("n").alias("n")
    )
    variance = 2 * F.col("total") - F.col("c0")
    per_chain = initial.withColumn("ess", F.least(F.col("n"), F.col("n") * F.try_divide("c0", variance)))
    return per_chain.groupBy("param").agg(F.sum("ess").alias("ess"), F.sum("n").alias("n"))


def ess_spectral(draws: DataFrame) -> DataFrame:
    """(param, ess, n): effective sample size from the spectrum at frequency zero of an autoregression, summed over chains.

    The autoregression of each chain solves the Yule-Walker equations by Levinson's recursion; its order, at most ten times the decimal
    logarithm of the chain's length n and below n - 1, has the least AIC, the lower of equal ones. A chain counts n * variance / spectrum, and none
    if it is constant or has fewer than two draws. Iterations must be consecutive (see `renumber_iterations`). One pass over the
    draws, whose lags grow with the logarithm of the longest chain only.
    """
    moments, centred = _centred(draws)
    orders = F.greatest(F.lit(0), F.least(F.col("n") - 2, F.floor(10 * F.log10("n"))))
    sums = autocovariance_sums(centred, 0, orders + 1)
    chains = sums.groupBy("chain", "param").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "s"))), lambda x: x["s"]).alias("sums"))

    @F.pandas_udf("double")
    def effective(all_sums: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([_spectral_size(np.asarray(s, float) / n, int(n)) for s, n in zip(all_sums, lengths)], dtype=float)

    sizes = chains.join(moments.select("chain", "param", "n"), ["chain", "param"]).withColumn("ess", effective("sums", "n"))
    return sizes.groupBy("param").agg(F.sum("ess").alias("ess"), F.sum("n").alias("n"))


def _spectral_size(c: np.ndarray, n: int) -> float:
    """Effective size of a chain of n draws with autocovariances c, those of lags 0 to the greatest order."""
    if n < 2 or not c[0] > 0:
        return 0.0
    weights, innovation = np.zeros(0), float(c[0])
    best = (n * math.log(innovation), innovation * n / (n - 1))
    for order in range(1, len(c)):
        reflection = (c[order] - weights @ c[1:order][::-1]) / innovation
        weights = np.append(weights - reflection * weights[::-1], reflection)
        innovation *= 1 - reflection * reflection
        if not innovation > 0:
            break
        criterion = n * math.log(innovation) + 2 * order
        if criterion < best[0]:
            best = (criterion, innovation * n / (n - order - 1) / (1 - weights.sum()) ** 2)
    return n * (c[0] * n / (n - 1)) / best[1]
