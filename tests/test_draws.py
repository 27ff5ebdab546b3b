"""Autocovariances, effective sizes and limits of draws against direct formulas."""

import math

import numpy as np
import pytest

from towline.operators import draws as draws_module
from towline.operators.draws import autocovariance_sums, ess_spectral, psrf
from towline.operators.regression import f_quantile


def test_autocovariances_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(draws_module, "BUCKET", 300)
    v = np.random.default_rng(9).normal(0, 1, 1000)
    df = spark.createDataFrame([(0, i, "p", float(x)) for i, x in enumerate(v)], "chain int, iter long, param string, v double")
    for low, high in ((0, 20), (7, 400), (250, 1000)):
        got = {r["lag"]: r["s"] for r in autocovariance_sums(df, low, high).collect()}
        assert sorted(got) == list(range(low, high))
        for k in range(low, high):
            assert got[k] == pytest.approx(v[: 1000 - k] @ v[k:], abs=1e-9)


def test_spectral_sample_size(spark):
    rng, n = np.random.default_rng(10), 1200
    v = np.zeros(n)
    for i in range(1, n):
        v[i] = 0.9 * v[i - 1] + rng.normal()
    rows = [(0, i, "p", float(x)) for i, x in enumerate(v)] + [(0, i, "flat", 2.0) for i in range(40)] + [(0, 0, "one", 1.0)]
    df = spark.createDataFrame(rows, "chain int, iter long, param string, value double")
    got = {r["param"]: r["ess"] for r in ess_spectral(df).collect()}
    assert got["flat"] == got["one"] == 0
    # Yule-Walker equations of every order by dense solving.
    d = v - v.mean()
    c = np.array([d[: n - k] @ d[k:] for k in range(31)]) / n
    best = None
    for order in range(31):
        matrix = c[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))]
        weights = np.linalg.solve(matrix, c[1 : order + 1]) if order else np.zeros(0)
        innovation = c[0] - weights @ c[1 : order + 1]
        criterion = n * math.log(innovation) + 2 * order
        if best is None or criterion < best[0]:
            best = (criterion, innovation * n / (n - order - 1) / (1 - weights.sum()) ** 2)
    assert got["p"] == pytest.approx(n * v.var(ddof=1) / best[1], rel=1e-9)
    assert 20 < got["p"] < 150  # 1200 / 19 in the limit


def test_upper_limit_of_scale_reduction(spark):
    # Printed tables of the F distribution.
    assert f_quantile(0.975, 3, 10) == pytest.approx(4.8256, abs=1e-4)
    assert f_quantile(0.95, 4, 20) == pytest.approx(2.8661, abs=1e-4)
    rng = np.random.default_rng(4)
    chains = [rng.normal(c / 5, 1 + c / 10, 60) for c in range(4)]
    rows = [(c, i, "p", float(x)) for c, values in enumerate(chains) for i, x in enumerate(values)] + [(0, i, "alone", float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "chain int, iter long, param string, value double")
    got = {r["param"]: r for r in psrf(df, adjust=False, confidence=0.95).collect()}
    s2 = np.array([c.var(ddof=1) for c in chains])
    w, ratio = s2.mean(), np.var([c.mean() for c in chains], ddof=1) * 1.25 / s2.mean()
    within = 2 * w * w / (s2.var(ddof=1) / 4)
    assert got["p"]["upper"] == pytest.approx(math.sqrt(59 / 60 + f_quantile(0.975, 3, within) * ratio), rel=1e-9)
    assert got["p"]["upper"] > got["p"]["psrf"] and got["alone"]["upper"] is None
