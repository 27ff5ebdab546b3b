"""Pair operators against brute force on small communities."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from towline.operators import blocks as bl
from towline.operators import ordination as ordi
from towline.operators.blocks import community
from towline.operators.dissimilarity import bray_curtis, dissimilarity_summary, wisconsin
from towline.operators.permanova import permanova, permanova_oneway, permuted_index
from towline.operators.simper import simper

UNITS, TAXA = 40, 7


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, (UNITS, TAXA)) * (rng.random((UNITS, TAXA)) < 0.6)
    x[:, 0] += 1
    x[3] = x[4]
    region = np.array([["north", "south", "east"][i % 3] for i in range(UNITS)])
    site = np.array([f"{region[i]}{i % 6}" for i in range(UNITS)])
    depth = rng.normal(20, 5, UNITS)
    return x.astype(float), region, site, depth


@pytest.fixture(scope="module")
def long(spark, data):
    x = data[0]
    cells = [(f"u{i:02d}", f"t{k}", float(x[i, k])) for i in range(UNITS) for k in range(TAXA) if x[i, k]]
    return spark.createDataFrame([*cells, ("empty", "t1", 0.0)], "unit string, taxon string, x double")


@pytest.fixture(scope="module")
def env(spark, data):
    _, region, site, depth = data
    return spark.createDataFrame(
        [(f"u{i:02d}", str(region[i]), str(site[i]), float(depth[i])) for i in range(UNITS)],
        "unit string, region string, site string, depth double")


def matrix(x):
    return np.abs(x[:, None] - x[None]).sum(2) / (x.sum(1)[:, None] + x.sum(1)[None])


def hat(columns):
    return columns @ np.linalg.pinv(columns)


def dummies(labels):
    return np.array([[float(v == level) for level in sorted(set(labels))[1:]] for v in labels])


def test_pairs_equal_brute_force_whatever_the_blocks(spark, long, data, monkeypatch):
    d = matrix(data[0])
    expected = {(f"u{i:02d}", f"u{j:02d}"): d[i, j] for i in range(UNITS) for j in range(i + 1, UNITS)}
    for size, strip in ((2048, 64), (5, 3), (1, 1)):
        monkeypatch.setattr(bl, "BLOCK_UNITS", size)
        monkeypatch.setattr(bl, "STRIP_UNITS", strip)
        got = {(r["i"], r["j"]): r["d"] for r in bray_curtis(long).collect()}
        assert got.keys() == expected.keys()
        assert max(abs(got[k] - expected[k]) for k in got) < 1e-12


def test_empty_units_are_counted_out(long):
    com = community(long)
    assert (com.n_units, com.n_excluded) == (UNITS, 1)


def test_double_standardisation(long, data):
    x = np.sqrt(data[0])
    x = x / x.max(0)
    x = x / x.sum(1)[:, None]
    for r in wisconsin(long.filter("unit <> 'empty'")).collect():
        assert abs(r["x"] - x[int(r["unit"][1:]), int(r["taxon"][1:])]) < 1e-12


def test_sequential_terms_match_projections(long, env, data):
    x, region, site, depth = data
    d2 = matrix(x) ** 2
    centre = np.eye(UNITS) - 1 / UNITS
    g = -centre @ d2 @ centre / 2
    ones = np.ones((UNITS, 1))
    designs = [ones, depth[:, None], dummies(region), dummies(site)]
    steps = [hat(np.hstack(designs[: k + 1])) for k in range(len(designs))]
    expected = [np.trace((steps[k] - steps[k - 1]) @ g) for k in range(1, len(designs))]
    got = {r["term"]: r for r in permanova(long, env, ["depth", "region", "site"], permutations=0).collect()}
    for name, value in zip(["depth", "region", "site"], expected):
        assert abs(got[name]["ss"] - value) < 1e-9
    assert got["site"]["df"] == 3
    assert abs(sum(got[t]["ss"] for t in ("depth", "region", "site", "residual")) - got["total"]["ss"]) < 1e-9
    assert abs(got["total"]["ss"] - np.triu(d2, 1).sum() / UNITS) < 1e-9


def test_one_factor_forms_agree(long, env):
    a = permanova_oneway(long, env, "region").first()
    b = {r["term"]: r for r in permanova(long, env, ["region"], permutations=0).collect()}
    assert abs(a["ss"] - b["region"]["ss"]) < 1e-9 and abs(a["f"] - b["region"]["f"]) < 1e-9
    assert (a["df"], a["df_residual"]) == (b["region"]["df"], b["residual"]["df"])


def test_interaction_adds_up_to_cells(long, env):
    full = {r["term"]: r for r in permanova(long, env.withColumn("deep", (F.col("depth") > 20).cast("string")),
                                             ["region*deep"], permutations=0).collect()}
    cells = permanova_oneway(long, env.withColumn("c", F.concat("region", (F.col("depth") > 20).cast("string"))), "c").first()
    assert abs(full["region"]["ss"] + full["deep"]["ss"] + full["region:deep"]["ss"] - cells["ss"]) < 1e-9


def test_a_factor_with_one_level_takes_no_freedom(long, env):
    got = permanova(long, env.withColumn("same", F.lit("x")), ["same"], permutations=3).collect()
    assert [(r["term"], r["df"]) for r in got] == [("same", 0), ("residual", UNITS - 1), ("total", UNITS - 1)]
    assert got[0]["ss"] is None and abs(got[1]["ss"] - got[2]["ss"]) < 1e-12


def test_permutations_are_bijections():
    for n in (1, 2, 3, 10, 64, 100, 1001):
        sent = permuted_index(np.arange(n), n, 9, np.arange(6))
        assert (np.sort(sent, axis=1) == np.arange(n)).all()
        assert (sent[0] == np.arange(n)).all()
    sent = permuted_index(np.arange(8), 8, 1, np.arange(1, 4001))
    assert np.abs(np.bincount(sent[:, 0], minlength=8) / 4000 - 1 / 8).max() < 0.03


def test_permutation_p_values_joined_and_broadcast_agree(spark, long, env):
    a = permanova(long, env, ["region", "depth"], permutations=99, seed=4).collect()
    b = permanova(long, env, ["region", "depth"], permutations=99, seed=4, broadcast_bytes=0).collect()
    for left, right in zip(a, b):
        assert left["p"] == right["p"] and abs(left["ss"] - right["ss"]) < 1e-9
    shifted = long.withColumn("x", F.when(F.col("unit").substr(2, 2).try_cast("int") % 3 == 0, F.col("x") * 40).otherwise(F.col("x")))
    assert permanova(shifted, env, ["region"], permutations=99, seed=4).first()["p"] <= 0.02


def test_simper_sums_to_between_group_dissimilarity(long, env, data):
    x, region, _, _ = data
    rows = simper(long, env, "region").collect()
    between = {(r["g1"], r["g2"]): r["mean_d"] for r in dissimilarity_summary(long, env, "region").collect()}
    for pair in {(r["g1"], r["g2"]) for r in rows}:
        mine = [r for r in rows if (r["g1"], r["g2"]) == pair]
        assert abs(sum(r["average"] for r in mine) - between[pair]) < 1e-12
        assert abs(max(r["cumulative"] for r in mine) - 1) < 1e-12
        a, b = x[region == pair[0]], x[region == pair[1]]
        c = np.abs(a[:, None] - b[None]) / (a.sum(1)[:, None, None] + b.sum(1)[None, :, None])
        for r in mine:
            k = int(r["taxon"][1:])
            assert abs(r["average"] - c[:, :, k].mean()) < 1e-12
            assert abs(r["sd"] - c[:, :, k].std(ddof=1)) < 1e-9
            assert abs(r["mean1"] - a[:, k].mean()) < 1e-12 and abs(r["mean2"] - b[:, k].mean()) < 1e-12


def test_simper_has_every_taxon_for_every_pair_of_groups(spark):
    cells = [("a1", "t0", 2.0), ("a2", "t0", 1.0), ("b1", "t0", 3.0), ("b1", "t1", 1.0), ("c1", "t0", 1.0), ("c1", "t2", 4.0)]
    long = spark.createDataFrame(cells, "unit string, taxon string, x double")
    env = spark.createDataFrame([(u, u[0]) for u in ("a1", "a2", "b1", "c1")], "unit string, region string")
    rows = simper(long, env, "region").collect()
    assert sorted((r["g1"], r["g2"], r["taxon"]) for r in rows) == sorted((a, b, f"t{k}") for a, b in ("ab", "ac", "bc") for k in range(3))
    assert {r["average"] for r in rows if (r["g1"], r["g2"], r["taxon"]) == ("a", "b", "t2")} == {0.0}


def test_tables_on_an_ordination(spark, rows):
    coords = spark.createDataFrame([("a", 0.0, 0.0), ("b", 2.0, 0.0), ("c", 0.0, 2.0)], "unit string, axis1 double, axis2 double")
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "unit string, group string")
    long = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 3.0), ("c", "z", 0.0)], "unit string, taxon string, x double")
    assert rows(ordi.taxon_scores(coords, long)) == [("t", 1.5, 0.0), ("z", None, None)]
    ellipse = {r["group"]: r for r in ordi.group_ellipse(coords, groups).collect()}
    assert abs(ellipse["g"]["major"] - np.sqrt(2 * -2 * np.log(0.05))) < 1e-9 and ellipse["g"]["minor"] == 0
    assert ellipse["h"]["major"] is None
    assert rows(ordi.group_spider(coords, groups), "unit", "center1") == [("a", 1.0), ("b", 1.0), ("c", 0.0)]
    env = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "unit string, sal double")
    assert rows(ordi.surface_grid(coords, env, "sal", nx=2, ny=2)) == [(0, 0, 1.0, 1), (1, 0, 3.0, 1)]


def test_many_taxa_take_memory_by_entries(spark, monkeypatch):
    """Fifty thousand taxa, few to a unit: the blocks hold entries only, and pairs and contributions equal brute force."""
    rng = np.random.default_rng(8)
    units = [dict(zip(rng.choice(50_000, 400, replace=False).tolist(), rng.integers(1, 50, 400).tolist())) | {u % 3: 7, 9: int(u) + 1} for u in range(60)]
    cells = [(u, f"t{k}", float(x)) for u, own in enumerate(units) for k, x in own.items()]
    table = spark.createDataFrame(cells, "unit long, taxon string, x double")
    com = community(table)
    assert com.n_entries == len(cells)
    monkeypatch.setattr(bl, "BLOCK_ENTRIES", 5_000)
    blocks, n_blocks = bl.blocks_of(com)
    assert n_blocks >= 5
    assert max(len(r["x"]) for r in blocks.select("x").collect()) < 8 * 3 * 5_000
    found = {(r["i"], r["j"]): r["d"] for r in bray_curtis(com).collect()}
    assert len(found) == 60 * 59 // 2
    for (i, j), d in found.items():
        keys = set(units[i]) | set(units[j])
        gap = sum(abs(units[i].get(k, 0) - units[j].get(k, 0)) for k in keys)
        assert abs(d - gap / (sum(units[i].values()) + sum(units[j].values()))) < 1e-12
    env = spark.createDataFrame([(u, "ab"[u % 2]) for u in range(60)], "unit long, region string")
    rows = {r["taxon"]: r for r in simper(com, env, "region").collect()}
    for taxon in (0, 9, next(iter(units[5]))):
        parts = [abs(units[i].get(taxon, 0) - units[j].get(taxon, 0)) / (sum(units[i].values()) + sum(units[j].values())) for i in range(0, 60, 2) for j in range(1, 60, 2)]
        assert abs(rows[f"t{taxon}"]["average"] - np.mean(parts)) < 1e-12 and abs(rows[f"t{taxon}"]["sd"] - np.std(parts, ddof=1)) < 1e-12


def test_units_of_equal_profile_are_paired_once(spark, data, monkeypatch):
    x, region, _, depth = data
    of = np.repeat(np.arange(12), 5)  # five copies of each of twelve profiles, in three regions
    values, regions, n = x[of], region[np.arange(60) % 30], 60
    depths = np.concatenate([depth, depth[:20] + 1])
    cells = [(i, f"t{k}", float(values[i, k])) for i in range(n) for k in range(TAXA) if values[i, k]]
    long = spark.createDataFrame(cells, "unit int, taxon string, x double")
    env = spark.createDataFrame([(i, str(regions[i]), float(depths[i])) for i in range(n)], "unit int, region string, depth double")
    distinct = len(np.unique(x[:12], axis=0))
    com = community(long)
    assert com.n_units == n and bl.copies_of(com.profiles).n_units == distinct
    monkeypatch.setattr(bl, "BLOCK_UNITS", 5)
    d = matrix(values)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    for r in dissimilarity_summary(com, env, "region").collect():
        among = [d[i, j] for i, j in pairs if sorted((regions[i], regions[j])) == [r["g1"], r["g2"]]]
        assert r["n_pairs"] == len(among) and abs(r["mean_d"] - np.mean(among)) < 1e-12
    total = values.sum(1)
    for r in simper(com, env, "region").collect():
        k = int(r["taxon"][1:])
        c = [abs(values[i, k] - values[j, k]) / (total[i] + total[j]) for i in range(n) for j in range(n) if (regions[i], regions[j]) == (r["g1"], r["g2"])]
        assert abs(r["average"] - np.mean(c)) < 1e-12 and abs(r["sd"] - np.std(c, ddof=1)) < 1e-9
    # The permutation test on pairs of units, without classes.
    design = np.hstack([np.ones((n, 1)), dummies(regions), depths[:, None]])
    q = np.linalg.qr(design)[0][:, 1:]
    sent = permuted_index(np.arange(n), n, 4, np.arange(30))
    ss = np.array([[-sum(d[i, j] ** 2 * (q[p[i]][c] @ q[p[j]][c]) for i, j in pairs) for c in (slice(0, 2), slice(2, 3))] for p in sent])
    whole = (d**2)[np.triu_indices(n, 1)].sum() / n
    f = ss / [2, 1] / ((whole - ss.sum(1)) / (n - 4))[:, None]
    got = {r["term"]: r for r in permanova(com, env, ["region", "depth"], permutations=29, seed=4).collect()}
    for k, term in enumerate(["region", "depth"]):
        assert abs(got[term]["ss"] - ss[0, k]) < 1e-9 and abs(got[term]["f"] - f[0, k]) < 1e-9
        assert got[term]["p"] == (1 + (f[1:, k] >= f[0, k] * (1 - 1e-12)).sum()) / 30
    assert abs(got["total"]["ss"] - whole) < 1e-9


def test_places_are_permuted_in_bounded_memory():
    index, permutations = np.arange(2000), np.arange(500)
    tracemalloc.start()
    sent = permuted_index(index, 6000, 3, permutations)  # the power of four above is 16,384, so most places are sent on
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sent.nbytes and sent.max() < 6000
