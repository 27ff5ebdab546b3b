"""Models against dense linear algebra, and draws against direct formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from towline.operators import regression as reg
from towline.operators import taxa as tx
from towline.operators.describe import describe_table, exact_quantiles
from towline.operators.design import categorical, design, design_rows, gram, numeric
from towline.operators.draws import draws_summary, ess, psrf, renumber_iterations, supported

N = 240


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    region = rng.choice(["a", "b", "c"], N)
    site = np.array([f"{r}{k}" for r, k in zip(region, rng.integers(0, 4, N))])
    year = rng.choice([2017, 2018, 2019], N)
    depth = rng.normal(20, 5, N)
    effect = {s: v for s, v in zip(sorted(set(site)), rng.normal(0, 0.8, 12))}
    y = 1 + 0.1 * depth + (region == "b") - 0.3 * (year - 2018) + np.array([effect[s] for s in site]) + rng.normal(0, 0.5, N)
    counts = rng.negative_binomial(2.0, 2.0 / (2.0 + np.exp(0.6 * (region == "b") + 0.05 * depth)))
    return region, site, year, depth, y, counts


@pytest.fixture(scope="module")
def frame(spark, data):
    region, site, year, depth, y, counts = data
    rows = [(i, str(region[i]), str(site[i]), int(year[i]), float(depth[i]), float(y[i]), int(counts[i])) for i in range(N)]
    return spark.createDataFrame(rows, "id long, region string, site string, year int, depth double, y double, n int").repartition(3)


def dummies(labels):
    return np.array([[float(v == level) for level in sorted(set(labels))[1:]] for v in labels])


def dense(data, interaction=False):
    region, _, year, depth, y, _ = data
    parts = [np.ones((N, 1)), dummies(region), depth[:, None], year[:, None].astype(float)]
    if interaction:
        parts.append(dummies(region) * depth[:, None])
    return np.hstack(parts), y


@pytest.mark.parametrize("interaction", [False, True])
def test_least_squares(spark, frame, data, interaction):
    x, y = dense(data, interaction)
    terms = ["region", "depth", numeric("year")] + (["region:depth"] if interaction else [])
    fit = reg.ols(frame, "y", terms)
    table = fit.table(spark).collect()
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    sigma2 = resid @ resid / (N - x.shape[1])
    se = np.sqrt(np.diag(np.linalg.pinv(x.T @ x)) * sigma2)
    assert np.allclose([r["estimate"] for r in table], beta, rtol=1e-5, atol=1e-7)
    assert np.allclose([r["se"] for r in table], se, rtol=1e-4)
    assert abs(fit.r2 - (1 - resid @ resid / ((y - y.mean()) @ (y - y.mean())))) < 1e-9


def test_residuals_leverage_and_effects(spark, frame, data):
    x, y = dense(data)
    fit = reg.ols(frame, "y", ["region", "depth", numeric("year")])
    rows = {r["id"]: r for r in reg.diagnostics(frame, "y", fit).collect()}
    h = np.diag(x @ np.linalg.pinv(x.T @ x) @ x.T)
    resid = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose([rows[i]["leverage"] for i in range(N)], h, atol=1e-8)
    assert np.allclose([rows[i]["residual"] for i in range(N)], resid, atol=1e-7)
    assert np.allclose([rows[i]["std_residual"] for i in range(N)], resid / np.sqrt(fit.sigma2 * (1 - h)), atol=1e-6)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    at = np.array([1, 1, 0, data[3].mean(), data[2].mean()])
    effect = {r["level"]: r for r in reg.term_effect(spark, fit, "region").collect()}
    assert abs(effect["b"]["fit"] - at @ beta) < 1e-6
    assert abs(effect["b"]["se"] - math.sqrt(at @ np.linalg.pinv(x.T @ x) @ at * fit.sigma2)) < 1e-6
    assert abs((effect["b"]["upper"] - effect["b"]["fit"]) / effect["b"]["se"] - 1.97) < 0.002
    partial = reg.partial_residuals(frame, "y", fit, "depth").filter("id = 5").first()
    assert abs(partial["partial_residual"] - partial["effect"] - resid[5]) < 1e-6


def test_aliased_terms_are_null(spark, frame, data):
    fit = reg.ols(frame, "y", ["region", "site"])
    table = fit.table(spark).collect()
    assert sum(r["estimate"] is None for r in table) == 2
    y, site = data[4], data[1]
    rss = sum(((y[site == s] - y[site == s].mean()) ** 2).sum() for s in set(site))
    assert abs(fit.sigma2 * fit.df_residual - rss) < 1e-8


def test_rows_without_a_logarithm_are_reported(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (2.0, 3.0), (4.0, None), (8.0, 4.0), (9.0, 6.0)], "c double, x double")
    fit = reg.ols(df, F.ln("c"), ["x"])
    assert (fit.n, fit.n_dropped) == (4, 2)


def test_wide_gram_equals_narrow(frame, data):
    columns = [F.lit(1.0), F.col("depth"), F.col("y")]
    many = columns + [F.col("depth") * k for k in range(2, 14)]
    wide = gram(frame, many, by=["region"])
    narrow = gram(frame, columns, by=["region"])
    assert set(wide) == set(narrow) == {("a",), ("b",), ("c",)}
    for key in narrow:
        assert np.allclose(wide[key][:3, :3], narrow[key])


def test_design_names_and_errors(frame):
    spec = design(frame, ["region*depth", categorical("year")])
    assert [c.name for c in spec.columns] == [
        "region[b]", "region[c]", "depth", "region[b]:depth", "region[c]:depth", "year[2018]", "year[2019]"]
    with pytest.raises(ValueError):
        design(frame, ["region:depth"])
    rows, names = design_rows(frame, ["region"], keep=["id"])
    assert names == ["(intercept)", "region[b]", "region[c]"] and len(rows.first()["x"]) == 3


def test_poisson_and_negative_binomial_scores_vanish(spark, frame, data):
    region, _, _, depth, _, counts = data
    x = np.hstack([np.ones((N, 1)), dummies(region), depth[:, None]])
    table = reg.glm_poisson(frame, "n", ["region", "depth"]).table(spark).collect()
    beta = np.array([r["estimate"] for r in table])
    mu = np.exp(x @ beta)
    assert np.abs(x.T @ (counts - mu)).max() < 1e-4
    assert np.allclose([r["se"] for r in table], np.sqrt(np.diag(np.linalg.inv(x.T @ (x * mu[:, None])))), rtol=1e-5)
    fit = reg.glm_negbin(frame, "n", ["region", "depth"])
    table = fit.table(spark).collect()
    beta, theta = np.array([r["estimate"] for r in table[:-1]]), fit.theta
    mu = np.exp(x @ beta)
    weight = 1 / (1 + mu / theta)
    assert np.abs(x.T @ ((counts - mu) * weight)).max() < 1e-4
    assert np.allclose([r["se"] for r in table[:-1]], np.sqrt(np.diag(np.linalg.inv(x.T @ (x * (mu * weight)[:, None])))), rtol=1e-4)

    def likelihood(t):
        return sum(math.lgamma(t + k) - math.lgamma(t) + t * math.log(t / (t + m)) + k * math.log(m / (t + m)) for k, m in zip(counts, mu))

    slope = (likelihood(theta * 1.0001) - likelihood(theta * 0.9999)) / (theta * 0.0002)
    assert abs(slope) < 1e-3


def test_digamma_and_trigamma(spark):
    df = spark.createDataFrame([(0.1,), (1.0,), (30.0,)], "x double").select(reg.digamma(F.col("x")), reg.trigamma(F.col("x")))
    expected = [(-10.423754940411076, 101.43329915079275), (-0.5772156649015329, 1.6449340668482264), (3.3844381327, 0.0338950603)]
    for got, want in zip(df.collect(), expected):
        assert abs(got[0] - want[0]) < 1e-8 and abs(got[1] - want[1]) < 1e-8


def test_random_intercept_maximises_restricted_likelihood(spark, frame, data):
    region, site, _, depth, y, _ = data
    x = np.hstack([np.ones((N, 1)), dummies(region), depth[:, None]])
    same = (site[:, None] == site[None]).astype(float)

    def criterion(ratio):
        v = np.eye(N) + ratio * same
        inv = np.linalg.inv(v)
        xx = x.T @ inv @ x
        beta = np.linalg.solve(xx, x.T @ inv @ y)
        e = y - x @ beta
        s2 = e @ inv @ e / (N - x.shape[1])
        return (N - x.shape[1]) * math.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1], s2, beta, np.sqrt(np.diag(np.linalg.inv(xx)) * s2)

    fit = reg.lmm_intercept(frame, "y", ["region", "depth"], "site")
    ratio = fit.group_variance / fit.sigma2
    best, s2, beta, se = criterion(ratio)
    assert fit.n_groups == 12
    assert best <= min(criterion(ratio * f)[0] for f in (0.5, 0.99, 1.01, 2.0)) + 1e-9
    assert abs(fit.sigma2 - s2) < 1e-8
    table = fit.table(spark).collect()
    assert np.allclose([r["estimate"] for r in table[:-2]], beta, atol=1e-6)
    assert np.allclose([r["se"] for r in table[:-2]], se, rtol=1e-5)


def test_no_group_variance_gives_least_squares(spark):
    rng = np.random.default_rng(1)
    # Groups whose means are exactly equal: the best variance is zero.
    rows = [(f"g{g}", float(v)) for g in range(6) for v in (-1.0, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "g string, y double").withColumn("x", F.col("y") * 0 + F.rand(3))
    del rng
    fit = reg.lmm_intercept(df.select("g", "y"), "y", [], "g")
    assert fit.group_variance == 0.0
    assert abs(fit.fit.intercept) < 1e-12


def test_random_intercept_with_groups_far_apart(spark):
    rng = np.random.default_rng(6)
    means, noise = rng.normal(0, 1000.0, 8), rng.normal(0, 0.5, (8, 5))
    y = means[:, None] + noise
    df = spark.createDataFrame([(f"g{g}", float(v)) for g in range(8) for v in y[g]], "g string, y double")
    fit = reg.lmm_intercept(df, "y", [], "g")
    # Balanced groups have a closed form.
    inner, outer = y.var(1, ddof=1).mean(), y.mean(1).var(ddof=1)
    assert fit.converged
    assert abs(fit.sigma2 / inner - 1) < 1e-5
    assert abs(fit.group_variance / (outer - inner / 5) - 1) < 1e-5


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 20, (30, 5)) * (rng.random((30, 5)) < 0.7)
    env = rng.normal(10, 2, 30)
    cells = [(i, f"t{k}", float(x[i, k])) for i in range(30) for k in range(5) if x[i, k]]
    return (x.astype(float), env, spark.createDataFrame(cells, "unit long, taxon string, x double"),
            spark.createDataFrame([(i, float(env[i])) for i in range(30)], "unit long, g double"))


def test_taxon_regressions_and_prediction(spark, long):
    x, g, cells, env = long
    design_matrix = np.column_stack([np.ones(30), g])
    beta = np.linalg.lstsq(design_matrix, x, rcond=None)[0]
    resid = x - design_matrix @ beta
    cov = np.linalg.inv(design_matrix.T @ design_matrix)
    for r in tx.taxa_ols(cells, env, ["g"]).collect():
        k, j = int(r["taxon"][1]), 0 if r["column"] == "(intercept)" else 1
        assert abs(r["estimate"] - beta[j, k]) < 1e-9
        assert abs(r["se"] - math.sqrt(resid[:, k] @ resid[:, k] / 28 * cov[j, j])) < 1e-9
    fold = np.arange(30) % 3
    got = tx.cross_predict(cells, env, ["g"], k=3).collect()
    assert len(got) == 150
    for r in got:
        train = fold != r["fold"]
        b = np.linalg.lstsq(design_matrix[train], x[train, int(r["taxon"][1])], rcond=None)[0]
        assert r["observed"] == x[r["unit"], int(r["taxon"][1])] and abs(r["predicted"] - design_matrix[r["unit"]] @ b) < 1e-9
    pairs = tx.taxon_association(tx.taxa_residuals(cells, env, ["g"]), 0.2).collect()
    expected = np.corrcoef(resid.T)
    assert len(pairs) == 15
    for r in pairs:
        want = expected[int(r["a"][1]), int(r["b"][1])]
        assert abs(r["r"] - want) < 1e-9 and (r["shown"] == r["r"] if abs(want) > 0.2 else r["shown"] == 0)


def test_text_keys_are_folded_by_hash(spark):
    folds = tx.assign_folds(spark.range(200).select(F.col("id").cast("string").alias("k")), "k", 4)
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {0, 1, 2, 3}


def test_scale_reduction_summary_and_support(spark):
    rng = np.random.default_rng(3)
    chains = {("p", c): rng.normal(0, 1, 50) for c in (0, 1)} | {("q", 0): rng.normal(0, 1, 50), ("q", 1): rng.normal(5, 1, 50)}
    rows = [(c, i, p, float(v)) for (p, c), values in chains.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "chain int, iter long, param string, value double")
    got = {r["param"]: r["psrf"] for r in psrf(df, adjust=False).collect()}
    for p in "pq":
        a, b = chains[(p, 0)], chains[(p, 1)]
        w, between = (a.var(ddof=1) + b.var(ddof=1)) / 2, 50 * np.var([a.mean(), b.mean()], ddof=1)
        assert abs(got[p] - math.sqrt((49 / 50 * w + 1.5 * between / 50) / w)) < 1e-9
    assert got["p"] < 1.2 < 2 < got["q"]
    summary = draws_summary(df)
    q = summary.filter("param = 'q'").first()
    values = np.concatenate([chains[("q", 0)], chains[("q", 1)]])
    assert abs(q["support"] - (values > 0).mean()) < 1e-12
    assert {r["param"]: r["supported"] == 0 for r in supported(summary, 0.6).collect()} == {"p": True, "q": False}


def test_effective_sample_size(spark):
    rng = np.random.default_rng(6)
    noise = rng.normal(0, 1, 2000)
    slow = np.zeros(2000)
    for i in range(1, 2000):
        slow[i] = 0.8 * slow[i - 1] + noise[i]
    rows = [(0, 2 * i + 7, p, float(v)) for p, values in (("iid", noise), ("ar", slow)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "chain int, iter long, param string, value double")
    got = {r["param"]: r["ess"] for r in ess(renumber_iterations(df), first_lags=8).collect()}
    assert got["iid"] > 1500 and 120 < got["ar"] < 330


def test_effective_sample_size_has_no_greatest_lag(spark):
    rng = np.random.default_rng(8)
    v = np.zeros(1500)
    for i in range(1, 1500):
        v[i] = 0.98 * v[i - 1] + rng.normal()
    d = v - v.mean()
    c = np.array([d[: 1500 - k] @ d[k:] for k in range(1500)]) / 1500
    gamma, total, least = c[0::2] + c[1::2], 0.0, np.inf
    for g in gamma:
        if g <= 0:
            break
        least = min(least, g)
        total += least
    df = spark.createDataFrame([(0, i, "p", float(x)) for i, x in enumerate(v)], "chain int, iter long, param string, value double")
    assert ess(df, first_lags=4).first()["ess"] == pytest.approx(min(1500, 1500 * c[0] / (2 * total - c[0])))


def test_student_and_f_tails():
    assert reg.t_quantile(1) == pytest.approx(12.7062047, rel=1e-7) and reg.t_quantile(2) == pytest.approx(4.3026527, rel=1e-7)
    assert reg.t_quantile(10) == pytest.approx(2.2281389, rel=1e-7)
    assert reg.t_p(2.0, 1) == pytest.approx(1 - 2 * math.atan(2.0) / math.pi)
    assert reg.f_p(4.0, 1, 7) == pytest.approx(reg.t_p(2.0, 7)) and reg.f_p(3.0, 2, 2) == pytest.approx(0.25)


def test_triple_product_has_all_parts(spark):
    df = spark.createDataFrame([(a, b, c, 1.0) for a in "xy" for b in "xy" for c in "xy"], "a string, b string, c string, y double")
    assert [t.replace("_", ":") for t in design(df, ["a*b*c"]).terms] == ["a", "b", "c", "a:b", "a:c", "b:c", "a:b:c"]


def test_renumbering_over_bucket_borders(spark):
    iters = [1, 65535, 65536, 70000, 400000]
    df = spark.createDataFrame([(0, i, "p", float(i)) for i in iters], "chain int, iter long, param string, value double")
    assert [r["value"] for r in renumber_iterations(df).orderBy("iter").collect()] == [float(i) for i in iters]
    assert [r["iter"] for r in renumber_iterations(df).orderBy("iter").collect()] == [0, 1, 2, 3, 4]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.lognormal(0, 4, 3000), np.full(1500, 2.5), [-1e12]])
    b = rng.integers(0, 3, len(a)).astype(float)
    df = spark.createDataFrame([(float(x), float(y) if y else None) for x, y in zip(a, b)], "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs)
    assert np.allclose(got["a"], np.quantile(a, probs), rtol=1e-12)
    assert np.allclose(got["b"], np.quantile(b[b > 0], probs), rtol=1e-12)
    summary = {r["column"]: r for r in describe_table(df).collect()}
    assert summary["b"]["n_null"] == int((b == 0).sum()) and abs(summary["a"]["median"] - np.median(a)) < 1e-12
    empty = describe_table(df.filter("a IS NULL")).collect()
    assert empty[0]["median"] is None
