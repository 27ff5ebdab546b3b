"""Periodic runs, nearest neighbours and hard negatives against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from towline.llm import negatives, runs, vectors, vptree


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def report(i, words):
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (i, len(words), len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), kept)


def periodic_text(rng):
    words = []
    while len(words) < rng.randrange(150):
        if rng.random() < 0.5:
            words += [f"w{rng.randrange(rng.choice([1, 2, 40]))}" for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 9)
        else:
            words += [f"w{rng.randrange(3)}" for _ in range(rng.randrange(4))]
    return rng.choice([" ", "\n", " \t "]).join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    rows = [(i, periodic_text(rng)) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "a a a a a"), (204, "a a a a a a"), (205, "A a " * 4), (206, "ab " * 7 + "b"), (None, "x y " * 5), (None, None)]
    rows += [(207, "é漢 é漢 é漢 é漢 é漢 é漢 ﬁn"), (208, "a b a b a b a b c a b a b a b a b"), rows[0], rows[0]]
    return rows


def same(df, expected, *columns):
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, expected))


COLUMNS = ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed")


def test_runs(spark, texts):
    rows = [(i, t, 7, "s", 1) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, planted string, h int").repartition(3)
    same(runs.periodic_runs(docs, whole=True), [report(i, (t or "").split()) for i, t in texts], *COLUMNS)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert runs.periodic_runs(named).filter("doc_id = 'd204'").first()["n_runs"] == 1
    listed = runs.periodic_runs(docs.filter("doc_id = 208"), whole=True).first()["runs"]
    assert [tuple(r) for r in listed] == [(0, 8, 2), (9, 8, 2)]


def test_planted_runs(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    expected = []
    for i, t in texts:
        words, h = (t or "").split(), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(len(words))]
        expected.append(report(i, words))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts if i is not None) > 5
    same(runs.periodic_runs(docs, planted=F.crc32(F.col("doc_id").cast("string").cast("binary")), whole=True), expected, *COLUMNS)


def test_runs_of_a_very_long_text(spark):
    rng = random.Random(3)
    words = [f"v{rng.randrange(5000)}" for _ in range(60_000)]
    words[20_000:50_000] = (words[20_000:21_000]) * 30
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x " * 100_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in runs.periodic_runs(docs, whole=True).collect()}
    assert found[1]["period"] == 1000 and found[1]["start"] <= 20_000 and found[1]["length"] >= 30_000
    assert (found[2]["start"], found[2]["length"], found[2]["period"], found[2]["collapsed"]) == (0, 100_000, 1, "x")


def test_words_that_share_a_hash(spark, texts, monkeypatch):
    """With hashes of two values most texts seem to hold runs; all are compared and done again exactly."""
    plain = runs.Words

    def poor(*arguments):
        words = plain(*arguments)
        words.hash = words.hash % np.uint64(2)
        return words

    monkeypatch.setattr(runs, "Words", poor)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    same(runs.periodic_runs(docs, whole=True), [report(i, (t or "").split()) for i, t in texts], *COLUMNS)
    words = [b"x", b"y"] * 5
    assert runs._exact_runs(words) == [(0, 10, 2)]


def clouds(rng, n, dims=12):
    centres = rng.standard_normal((6, dims)) * 3
    rows = []
    for i in range(n):
        vector = (centres[rng.integers(6)] + rng.standard_normal(dims)).astype(np.float32).tolist()
        rows.append([i, vector, int(rng.integers(4))])
    for i in range(40):
        rows[10 * i + 3][1] = rows[100][1]  # copies, so that distances tie
    rows[5][1], rows[6][1], rows[7][1], rows[8][1] = None, [None] * dims, [0.0] * dims, [float("nan")] + [1.0] * (dims - 1)
    rows[200][1], rows[9][1], rows[11][1], rows[12][1] = None, [], [1.0, 2.0], [2.0, 1.0]
    rows[300][1], rows[13][2], rows[400][2] = [3.0, 4.0], None, None
    rows.append([17, rows[17][1], rows[17][2]])
    rows.append([None, rows[18][1], 1])
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, ids string, data int, dims int, score double"


def table(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, 2, 0.5) for r in rows], SCHEMA).repartition(4)


def brute_nearest(rows, k=10):
    used = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in used:
        if q % 100:
            continue
        away = []
        for i, b in used:
            if i != q and len(a) == len(b):
                total = 0.0
                for x, y in zip(a, b):
                    total += (x - y) * (x - y)
                away.append((math.sqrt(total), i))
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(sorted(away)[:k])]
    return out


@pytest.mark.parametrize("shard_rows,leaf_rows", [(8192, 64), (150, 4)])
def test_nearest(spark, shard_rows, leaf_rows):
    rows = clouds(np.random.default_rng(4), 900)
    df = table(spark, rows)
    found = vptree.nearest(df, df.filter("vec_id % 100 = 0"), shard_rows=shard_rows, leaf_rows=leaf_rows)
    same(found, brute_nearest(rows), "query_id", "rank", "vec_id", "score")


def test_nearest_at_the_edges(spark):
    rows = clouds(np.random.default_rng(4), 450)
    df = table(spark, rows)
    assert vptree.nearest(df.limit(0), df).count() == 0
    assert vptree.nearest(df, df.limit(0)).count() == 0
    few = df.filter("vec_id in (100, 20, 21)")
    assert [tuple(r)[:3] for r in vptree.nearest(few, few.filter("vec_id = 100")).orderBy("rank").select("query_id", "rank", "vec_id").collect()] in (
        [(100, 1, 20), (100, 2, 21)], [(100, 1, 21), (100, 2, 20)])
    # Query blocks that may not be broadcast meet the shards by numbers.
    met = vectors.met
    same(vptree.nearest(df, df.filter("vec_id % 100 = 0"), shard_rows=64), brute_nearest(rows), "query_id", "rank", "vec_id", "score")
    vptree.met, limit = lambda a, b: met(a, b, limit=1), vptree.met
    try:
        same(vptree.nearest(df, df.filter("vec_id % 100 = 0"), shard_rows=64), brute_nearest(rows), "query_id", "rank", "vec_id", "score")
    finally:
        vptree.met = limit


def test_a_greater_factor_measures_less():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16)) * 2
    matrix = (centres[rng.integers(40, size=4000)] + 0.5 * rng.standard_normal((4000, 16))).astype(np.float32)
    ids, tree = np.arange(4000), vptree.build(matrix)
    assert sorted(tree.rows.tolist()) == ids.tolist()
    exact, measured = None, []
    for factor in (1.0, 1.5, 3.0):
        search = vptree.Search(ids[::100], matrix[::100], 10, factor)
        search.shard(ids, matrix, tree)
        measured.append(search.measured)
        exact = search.found if exact is None else exact
        recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, search.found)])
        assert recall >= (1.0 if factor == 1 else 0.9 if factor == 1.5 else 0.5)
    assert 40 * 4000 > measured[0] > measured[1] > measured[2]


def brute_negatives(rows, n_positive=5, n_negative=10, low=30, high=90):
    used = [(i, v, y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None for x in v)]
    out = []
    for a, va, ya in used:
        if a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in used if i != a and len(v) == len(va)))
        for s, p, _ in [r for r in scored if r[2] == ya][:n_positive]:
            window = [(n, t) for t, n, label in scored if label != ya and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(window[:n_negative])]
    return out


NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("scale", [1, 2, 40])
def test_hard_negatives(spark, scale, monkeypatch):
    """A small scale gives many ties, and positives of score 0 whose window is that score alone."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(scale)
    rows = [[i, rng.integers(-scale, scale + 1, 6).tolist(), int(rng.integers(3))] for i in range(700)]
    for i in range(30):
        rows[7 * i][1] = rows[100][1]
    rows[200][1] = [0] * 6
    rows[5][1], rows[6][1], rows[7][2], rows[8][1], rows[300][2], rows[9][1], rows[400][1] = None, [None] + [1] * 5, None, [1, 2], None, [], [1, 2]
    rows += [[11, rows[11][1], rows[11][2]], [None, rows[12][1], 1], [13, rows[14][1], rows[14][2]]]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, vector array<long>, label int, ids int, labels string, score double").repartition(4)
    expected = brute_negatives(rows)
    assert scale > 1 or any(r[4] == 0 for r in expected)
    same(negatives.hard_negatives(df, df.filter("vec_id % 100 = 0")), expected, *NAMES)
    if scale == 2:
        same(negatives.hard_negatives(df, df.filter("vec_id % 100 = 0"), low=0, high=100), brute_negatives(rows, low=0, high=100), *NAMES)
        met = vectors.met
        monkeypatch.setattr(negatives, "met", lambda a, b: met(a, b, limit=1))
        same(negatives.hard_negatives(df, df.filter("vec_id % 100 = 0")), expected, *NAMES)
        assert negatives.hard_negatives(df.limit(0), df).count() == 0
        assert negatives.hard_negatives(df, df.limit(0)).count() == 0


def test_products_beyond_64_bits():
    big = np.array([[1 << 40, 3]])
    assert negatives.inner_products(big // 1024, big // 1024)[0, 0] == (1 << 60) + 0
    with pytest.raises(OverflowError):
        negatives.inner_products(big, big)
