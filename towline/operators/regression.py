"""Regressions on catch. One pass gives the Gram matrix; only p x p numbers reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_column
from ..session import cut
from .design import Design, design, factor, gram, term_variables

_TABLE = "term string, column string, estimate double, se double, statistic double, p double"


def normal_p(statistic: float) -> float:
    """Two-sided p-value of a statistic under the normal approximation."""
    return math.erfc(abs(statistic) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz steps)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, m, value = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1)), 0, 0.0
    value = d
    while True:
        m += 1
        before = value
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= c * d
        if abs(value - before) <= 1e-15 * abs(value):
            return front * value


def t_p(statistic: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return float(incomplete_beta(df / 2, 0.5, df / (df + statistic * statistic))) if df > 0 else float("nan")


def f_p(statistic: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * statistic)) if df1 > 0 and df2 > 0 else float("nan")


def t_quantile(df: float) -> float:
    """97.5 % point of Student's t, by bisection on its p-value."""
    if df <= 0:
        return float("nan")
    low, high = 0.0, 2.0
    while t_p(high, df) > 0.05:
        high *= 2
    while high - low > 1e-12 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if t_p(middle, df) > 0.05 else (low, middle)
    return high


def f_quantile(p: float, df1: float, df2: float) -> float:
    """The point of the F distribution with probability `p` below it, by bisection on its upper tail."""
    low, high = 0.0, 1.0
    while f_p(high, df1, df2) > 1 - p:
        low, high = high, 2 * high
    while high - low > 1e-13 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if f_p(middle, df1, df2) > 1 - p else (low, middle)
    return high


@dataclass
class Fit:
    """A fitted linear predictor. `kept` lists the design columns that were not aliased."""

    spec: Design
    kept: list[int]
    coefficients: np.ndarray
    intercept: float
    unscaled: np.ndarray
    means: np.ndarray
    n: int
    n_dropped: int
    sigma2: float
    df_residual: int
    r2: float | None
    extra: dict

    def _columns(self):
        return [self.spec.columns[k] for k in self.kept]

    def predictor(self) -> Column:
        """Linear predictor as a column expression."""
        parts = [F.lit(float(b)) * c.raw for b, c in zip(self.coefficients, self._columns())]
        return reduce(lambda a, b: a + b, parts, F.lit(float(self.intercept)))

    def leverage(self) -> Column:
        """Leverage of a row, from the triangular factor of the centred design."""
        inverse = self.extra["inverse"]
        centred = [c.raw - F.lit(float(m)) for c, m in zip(self._columns(), self.means)]
        total = F.lit(1.0 / self.n)
        for k in range(len(centred)):
            q = reduce(lambda a, b: a + b, [centred[j] * F.lit(float(inverse[j, k])) for j in range(k + 1)])
            total = total + q * q
        return total

    def covariance(self) -> np.ndarray:
        """Covariance of the intercept and the kept coefficients."""
        if "covariance" in self.extra:
            return self.extra["covariance"]
        shift = np.vstack([-self.means @ self.unscaled, self.unscaled]) if self.kept else np.zeros((1, 0))
        top = np.concatenate([[1.0 / self.n + self.means @ self.unscaled @ self.means], shift[0]])
        matrix = np.vstack([top, np.column_stack([shift[0], self.unscaled])]) if self.kept else np.array([[1.0 / self.n]])
        return matrix * self.sigma2

    def table(self, spark) -> DataFrame:
        """One row per design column; an aliased one has a NULL estimate."""
        se = np.sqrt(np.diag(self.covariance()))

        def line(term, name, estimate, error):
            t = float(estimate / error) if error > 0 else float("nan")
            # Least squares estimates its error variance, so Student's t; the other fits are asymptotic.
            return term, name, float(estimate), float(error), float(t), t_p(t, self.df_residual) if "rss" in self.extra else normal_p(t)

        rows = [line("(intercept)", "(intercept)", self.intercept, se[0])]
        place = {k: i for i, k in enumerate(self.kept)}
        for k, c in enumerate(self.spec.columns):
            if k in place:
                rows.append(line(c.term, c.name, self.coefficients[place[k]], se[1 + place[k]]))
            else:
                rows.append((c.term, c.name, None, None, None, None))
        return spark.createDataFrame(rows, _TABLE)


def model_frame(df: DataFrame, y, terms: Sequence, keep: Sequence[str] = ()) -> tuple[DataFrame, Design, int]:
    """The response as `__y` with the variables the terms use, written once; and the dropped row count.

    Rows with an unknown variable or response (such as the logarithm of zero catch) are dropped.
    """
    names = dict.fromkeys([*keep, *term_variables(terms)])
    frame = cut(df.select(*names, as_column(y).cast("double").alias("__y")))
    spec = design(frame.filter(F.col("__y").isNotNull() & ~F.isnan("__y")), terms)
    good = F.lit(True)
    for name in ["__y", *spec.variables]:
        good = good & F.col(name).isNotNull()
    good = good & ~F.isnan("__y")
    dropped = frame.agg(F.count_if(~good)).first()[0]
    return frame.filter(good), spec, int(dropped)


def _solve(spec: Design, matrix: np.ndarray, y_anchor: float, n_dropped: int) -> Fit:
    last = matrix.shape[0] - 1
    fit = factor(matrix[:last, :last])
    n = fit.n
    y_mean = matrix[0, last] / n
    xy = matrix[1:last, last] - n * fit.means * y_mean
    yy = matrix[last, last] - n * y_mean**2
    kept = fit.kept
    loading = fit.inverse.T @ xy[kept]
    coefficients = fit.inverse @ loading
    anchors = np.array([spec.columns[k].anchor for k in kept])
    means = fit.means[kept] + anchors
    df_residual = int(round(n)) - len(kept) - 1
    rss = max(0.0, yy - loading @ loading)
    return Fit(
        spec, kept, coefficients, float(y_mean + y_anchor - coefficients @ means), fit.inverse @ fit.inverse.T, means,
        n, n_dropped, float(rss / df_residual) if df_residual > 0 else float("nan"), df_residual,
        float(1 - rss / yy) if yy > 0 else None, {"rss": rss, "inverse": fit.inverse},
    )


def ols(df: DataFrame, y, terms: Sequence) -> Fit:
    """Least squares with treatment-coded factors, numeric terms and interactions."""
    frame, spec, dropped = model_frame(df, y, terms)
    y_anchor = frame.agg(F.avg("__y")).first()[0] or 0.0
    columns = [F.lit(1.0), *[c.shifted() for c in spec.columns], F.col("__y") - F.lit(y_anchor)]
    fit = _solve(spec, gram(frame, columns)[()], y_anchor, dropped)
    return replace(fit, n=int(round(fit.n)))


def fit_statistics(spark, fit: Fit) -> DataFrame:
    """Size, dropped rows, residual standard error and R squared of a fit."""
    return spark.createDataFrame(
        [(fit.n, fit.n_dropped, fit.df_residual, math.sqrt(fit.sigma2), None if fit.r2 is None else float(fit.r2))],
        "n bigint, n_dropped bigint, df_residual bigint, sigma double, r2 double",
    )


def model_test(spark, fit: Fit) -> DataFrame:
    """Overall F test of a least-squares fit against its mean alone, and its Akaike criterion."""
    k, rss = len(fit.kept), fit.extra["rss"]
    f = None if fit.r2 is None or fit.r2 >= 1 or k == 0 or fit.df_residual <= 0 else (fit.r2 / k) / ((1 - fit.r2) / fit.df_residual)
    aic = fit.n * (math.log(2 * math.pi * rss / fit.n) + 1) + 2 * (k + 2) if rss > 0 else None
    return spark.createDataFrame(
        [(k, fit.df_residual, f, None if f is None else f_p(f, k, fit.df_residual), aic)], "df_model bigint, df_residual bigint, f double, p double, aic double",
    )


def diagnostics(df: DataFrame, y, fit: Fit) -> DataFrame:
    """Add fitted value, residual, leverage, standardised residual and Cook's distance to every usable row."""
    rows = fit.spec.complete(df.withColumn("__y", as_column(y).cast("double")), "__y")
    rows = rows.withColumns({"fitted": fit.predictor(), "leverage": fit.leverage()})
    rows = rows.withColumn("residual", F.col("__y") - F.col("fitted")).drop("__y")
    spare = F.lit(1.0) - F.col("leverage")
    scaled = F.when(spare > 1e-12, F.col("residual") / F.sqrt(F.lit(fit.sigma2) * spare))
    p = len(fit.kept) + 1
    return rows.withColumns({
        "std_residual": scaled,
        "cook": F.when(spare > 1e-12, scaled * scaled * F.col("leverage") / (spare * F.lit(float(p)))),
    })


def _effect_row(fit: Fit, term: str, level: str | None, value: float | None) -> np.ndarray:
    """Design row with `term` at a level or value and every other variable at its mean."""
    main_mean = {}
    for k, mean in zip(fit.kept, fit.means):
        parts = fit.spec.columns[k].parts
        if len(parts) == 1:
            main_mean[parts[0]] = mean
    row = []
    for k in fit.kept:
        x = 1.0
        for name, part in fit.spec.columns[k].parts:
            if name != term:
                x *= main_mean.get((name, part), 0.0)
            elif part is None:
                x *= value if value is not None else main_mean.get((name, None), 0.0)
            else:
                x *= 1.0 if part == level else 0.0
        row.append(x)
    return np.array([1.0, *row])


def term_effect(spark, fit: Fit, term: str, values: Sequence[float] = ()) -> DataFrame:
    """Fitted value per level (or per given value of a numeric term), other terms at their means, with 95 % limits."""
    beta = np.concatenate([[fit.intercept], fit.coefficients])
    covariance = fit.covariance()
    width = t_quantile(fit.df_residual)
    numeric = fit.spec.variables[term].kind == "numeric"
    points = [(f"{v:g}", None, float(v)) for v in values] if numeric else [(v, v, None) for v in fit.spec.levels[term]]
    rows = []
    for label, level, value in points:
        x = _effect_row(fit, term, level, value)
        center, se = float(x @ beta), float(np.sqrt(max(0.0, x @ covariance @ x)))
        rows.append((label, center, se, center - width * se, center + width * se))
    return spark.createDataFrame(rows, "level string, fit double, se double, lower double, upper double")


def partial_residuals(df: DataFrame, y, fit: Fit, term: str) -> DataFrame:
    """Rows with the effect of a term at their level, the residual, and their sum (the partial residual)."""
    rows = fit.spec.complete(df.withColumn("__y", as_column(y).cast("double")), "__y")
    beta = np.concatenate([[fit.intercept], fit.coefficients])
    if fit.spec.variables[term].kind == "numeric":
        at0 = float(_effect_row(fit, term, None, 0.0) @ beta)
        at1 = float(_effect_row(fit, term, None, 1.0) @ beta)
        effect = F.lit(at0) + F.lit(at1 - at0) * F.col(term)
    else:
        cells = [F.lit(v) for level in fit.spec.levels[term]
                 for v in (level, float(_effect_row(fit, term, level, None) @ beta))]
        effect = F.try_element_at(F.create_map(*cells), F.col(term).cast("string"))
    rows = rows.withColumns({"effect": effect, "residual": F.col("__y") - fit.predictor()}).drop("__y")
    return rows.withColumn("partial_residual", F.col("effect") + F.col("residual"))


# ---------------------------------------------------------------- counts


def _weighted_step(frame: DataFrame, spec: Design, mu: Column, theta: float, dropped: int) -> Fit:
    """One reweighted least-squares step for a log link; theta is infinite for Poisson."""
    count = F.col("__y")
    working = F.ln(mu) + (count - mu) / mu
    weight = F.sqrt(mu if math.isinf(theta) else mu / (F.lit(1.0) + mu / F.lit(theta)))
    columns = [F.lit(1.0), *[c.shifted() for c in spec.columns], working]
    step = _solve(spec, gram(frame, [weight * c for c in columns])[()], 0.0, dropped)
    step.extra["weight"] = step.n
    return step


def _count_fit(step: Fit, frame_size: int) -> Fit:
    """A converged step as a fit: unit dispersion, and standard errors from the weights."""
    covariance = replace(step, sigma2=1.0, n=step.extra["weight"]).covariance()
    return replace(step, n=frame_size, sigma2=1.0, df_residual=frame_size - len(step.kept) - 1, r2=None,
                   extra=step.extra | {"covariance": covariance})


def _start(count: Column) -> Column:
    return count + F.when(count == 0, F.lit(1 / 6)).otherwise(F.lit(0.0))


def _settled(state: np.ndarray, previous: np.ndarray | None, tolerance: float) -> bool:
    return previous is not None and bool(np.max(np.abs(state - previous) / (1 + np.abs(previous))) < tolerance)


def glm_poisson(df: DataFrame, y, terms: Sequence, max_iter: int = 30, tolerance: float = 1e-10) -> Fit:
    """Poisson regression with a log link, one weighted Gram pass per step."""
    frame, spec, dropped = model_frame(df, y, terms)
    size = frame.count()
    mu, previous = _start(F.col("__y")), None
    for _ in range(max_iter):
        step = _weighted_step(frame, spec, mu, math.inf, dropped)
        mu = F.exp(step.predictor())
        state = np.concatenate([[step.intercept], step.coefficients])
        if _settled(state, previous, tolerance):
            break
        previous = state
    return _count_fit(step, size)


def digamma(x: Column) -> Column:
    """Digamma for x > 0: recurrence up by eight, then the asymptotic series."""
    total = reduce(lambda a, b: a + b, [F.lit(1.0) / (x + i) for i in range(8)])
    z = x + 8
    w = F.lit(1.0) / (z * z)
    series = w * (F.lit(1 / 12) - w * (F.lit(1 / 120) - w * (F.lit(1 / 252) - w * (F.lit(1 / 240) - w * F.lit(1 / 132)))))
    return F.ln(z) - F.lit(0.5) / z - series - total


def trigamma(x: Column) -> Column:
    """Trigamma for x > 0, in the same way."""
    total = reduce(lambda a, b: a + b, [F.lit(1.0) / ((x + i) * (x + i)) for i in range(8)])
    z = x + 8
    w = F.lit(1.0) / (z * z)
    series = w * (F.lit(1 / 6) - w * (F.lit(1 / 30) - w * (F.lit(1 / 42) - w * (F.lit(1 / 30) - w * F.lit(5 / 66)))))
    return F.lit(1.0) / z + F.lit(0.5) * w + series / z + total


@dataclass
class NegativeBinomialFit:
    fit: Fit
    theta: float
    theta_se: float | None
    iterations: int

    def table(self, spark) -> DataFrame:
        """Coefficient rows and a last row for the dispersion parameter theta."""
        extra = spark.createDataFrame([("theta", "theta", self.theta, self.theta_se, None, None)], _TABLE)
        return self.fit.table(spark).unionByName(extra)


def glm_negbin(df: DataFrame, y, terms: Sequence, max_iter: int = 60, tolerance: float = 1e-9) -> NegativeBinomialFit:
    """Negative-binomial regression with a log link and dispersion by maximum likelihood.

    Each round is one weighted Gram pass for the coefficients and one aggregate for a Newton step of
    theta, alternating until both settle. Nothing but those sums leaves the executors.
    """
    frame, spec, dropped = model_frame(df, y, terms)
    size = frame.count()
    count = F.col("__y")
    mu, theta, previous = _start(count), math.inf, None
    for iteration in range(1, max_iter + 1):
        step = _weighted_step(frame, spec, mu, theta, dropped)
        mu = F.exp(step.predictor())
        if math.isinf(theta):
            theta = size / frame.agg(F.sum((count / mu - 1) * (count / mu - 1))).first()[0]
        t = F.lit(theta)
        score, information = frame.agg(
            F.sum(digamma(t + count) - digamma(t) + F.ln(t) + 1 - F.ln(t + mu) - (count + t) / (mu + t)),
            F.sum(trigamma(t) - trigamma(t + count) - 1 / t + 2 / (mu + t) - (count + t) / ((mu + t) * (mu + t))),
        ).first()
        moved = theta + score / information
        theta = moved if 0 < moved < 10 * theta else theta * (10 if moved > 0 else 0.5)
        state = np.concatenate([[step.intercept], step.coefficients, [math.log(theta)]])
        if _settled(state, previous, tolerance):
            break
        previous = state
    error = math.sqrt(1 / information) if information > 0 else None
    return NegativeBinomialFit(_count_fit(step, size), float(theta), error, iteration)


# ---------------------------------------------------------------- random intercept


# Logarithms of the variance ratios between which double precision tells one from another; a fit at the largest has not converged.
SMALLEST, LARGEST = -36.0, 24.0


@dataclass
class MixedFit:
    fit: Fit
    sigma2: float
    group_variance: float
    n_groups: int
    criterion: float
    converged: bool

    def table(self, spark) -> DataFrame:
        """Fixed effects, then the two variances."""
        rows = [("variance", "group", float(self.group_variance), None, None, None),
                ("variance", "residual", float(self.sigma2), None, None, None)]
        return self.fit.table(spark).unionByName(spark.createDataFrame(rows, _TABLE))


def lmm_intercept(df: DataFrame, y, terms: Sequence, group: str, points: int = 16, rounds: int = 40,
                  tolerance: float = 1e-7) -> MixedFit:
    """Linear model with a random intercept per group, fitted by restricted likelihood.

    A group enters only through its size and its sums of x and y. For a variance ratio the restricted
    likelihood needs one weighted Gram matrix over the groups, and a whole grid of ratios is one pass;
    the grid moves on while the best ratio is at its edge, then closes in on it until neighbouring ratios differ by less than
    `tolerance`; `converged` says whether that was reached within `rounds`. Groups stay in Spark, however many there are.
    """
    frame, spec, dropped = model_frame(df.filter(F.col(group).isNotNull()), y, terms, keep=[group])
    y_anchor = frame.agg(F.avg("__y")).first()[0] or 0.0
    columns = [F.lit(1.0), *[c.shifted() for c in spec.columns], F.col("__y") - F.lit(y_anchor)]
    matrix = gram(frame, columns)[()]
    base = _solve(spec, matrix, y_anchor, dropped)
    chosen = [0, *[k + 1 for k in base.kept]]
    last = matrix.shape[0] - 1
    used = [*chosen, last]
    sums = [F.sum(columns[k]).alias(f"s{i}") for i, k in enumerate(used)]
    groups = cut(frame.groupBy(group).agg(*sums).drop(group))
    n_groups = groups.count()
    width = len(used)
    total = matrix[np.ix_(used, used)]
    n, p = base.n, len(chosen)

    within = total - gram(groups, [F.col(f"s{k}") / F.sqrt("s0") for k in range(width)])[()]
    # Columns that are constant in every group have only rounding there.
    constant = np.diag(within) <= 1e-12 * np.diag(total)
    within[constant, :], within[:, constant] = 0.0, 0.0

    def evaluate(ratios: list[float]) -> dict[float, tuple]:
        number = F.explode(F.array([F.struct(F.lit(i).alias("i"), F.lit(v).alias("ratio")) for i, v in enumerate(ratios)]))
        grid = groups.withColumn("g", number).withColumns({"i": F.col("g.i"), "ratio": F.col("g.ratio")})
        # What a group's means keep; with the squares within groups this stays exact where ratios are large.
        shrink = F.sqrt(1 / (F.col("s0") * (1 + F.col("ratio") * F.col("s0"))))
        # The square of the last column sums to the log determinant, so one pass gives both.
        determinant = F.sqrt(F.log1p(F.col("ratio") * F.col("s0")))
        pulled = gram(grid, [*[shrink * F.col(f"s{k}") for k in range(width)], determinant], by=["i"])
        found = {}
        for i, ratio in enumerate(ratios):
            v = within + pulled[(i,)][:width, :width]
            xx, xy, yy = v[:p, :p], v[:p, p], v[p, p]
            chol = np.linalg.cholesky(xx)
            loading = np.linalg.solve(chol, xy)
            rss = max(yy - loading @ loading, 1e-300)
            sigma2 = rss / (n - p)
            criterion = (n - p) * math.log(sigma2) + pulled[(i,)][width, width] + 2 * np.log(np.diag(chol)).sum()
            found[ratio] = (criterion, sigma2, np.linalg.solve(chol.T, loading), np.linalg.inv(xx))
        return found

    low, high = -12.0, 8.0
    best_ratio, best = 0.0, evaluate([0.0])[0.0]
    converged = False
    for _ in range(rounds):
        places = np.linspace(low, high, points)
        found = evaluate([float(math.exp(v)) for v in places])
        order = sorted(found, key=lambda ratio: found[ratio][0])
        if found[order[0]][0] < best[0] - (1e-12 * abs(best[0]) if best_ratio == 0 else 0):
            best_ratio, best = order[0], found[order[0]]
        at, gap = math.log(order[0]), (high - low) / (points - 1)
        # Only while places are far apart: close to the optimum rounding decides which is best.
        if gap > 1 and high - at < gap / 2 and at < LARGEST:
            low, high = at - gap, min(at - gap + 20, LARGEST)
        elif gap > 1 and at - low < gap / 2 and at > SMALLEST:
            low, high = at + gap - 20, at + gap
        elif gap < tolerance:
            converged = at < LARGEST - 1e-3
            break
        else:
            low, high = at - gap, min(at + gap, LARGEST)
    criterion, sigma2, beta, inverse = best
    anchors = np.array([spec.columns[k].anchor for k in base.kept])
    # The design was shifted by its anchors: undo that in the intercept and its covariance.
    back = np.eye(p)
    back[0, 1:] = -anchors
    beta, covariance = back @ beta, back @ inverse @ back.T
    fit = Fit(spec, base.kept, beta[1:], float(beta[0] + y_anchor), covariance[1:, 1:], base.means, n, dropped, sigma2,
              base.df_residual, None, base.extra | {"covariance": covariance * sigma2})
    return MixedFit(fit, float(sigma2), float(best_ratio * sigma2), n_groups, float(criterion), converged)
