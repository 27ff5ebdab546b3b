"""Operators of the training-data folder against plain Python, on small tables with the awkward rows."""

import base64
import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from towline.llm import factors, jaccard, lines, outliers, packing, quality, toxicity, warc, winnow
from towline.llm.components import components
from towline.llm.langid import predict_languages
from towline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
# Columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, key string, w string, `set` string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    long = "\n".join(prose(rng, 40) for _ in range(60))
    near = base.split()
    near[60] = "changed"
    line = prose(rng, 30)
    edited = line.split()
    edited[7] = "other"
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "One"), (8, long), (9, long + "\n" + base),
        (10, line + "\n" + prose(rng, 15)), (11, prose(rng, 15) + "\n" + " ".join(edited)), (12, "a b a b a b a b a b a b a b a b a b a b a b a b a b"),
        (13, prose(rng, 25).upper()), (14, "Ünï cödé – wörter ßtraße 漢字 " * 4), (None, base), (None, prose(rng, 30)), (15, prose(rng, 5)), (15, prose(rng, 50)),
        (16, prose(rng, 44)), (16, None), (17, "x " * 30 + base[:200]), (18, base + " " + prose(rng, 20)), (19, "the\nthe\nThe!\n\nthe end of it\nthe end of it"),
    ]
    rows += [(i, base.replace("w1 ", f"v{i} ")) for i in range(20, 40)]
    rows.append(rows[10])  # a row twice
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if k % 3 else None, None if k % 5 == 0 else "hot", len(t or ""), 1.0, k, "k", "w", "s") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(df, expected, *columns):
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, expected))


def test_winnowing(spark, docs, texts):
    base = texts[0][1].split()
    items = [(1, " ".join(base[20:45])), (2, "one"), (3, None), (4, ""), (None, " ".join(base)), (10, " ".join(base[30:39]).upper()), (5, "zz yy"), (1, " ".join(base[20:45])), (6, prose(random.Random(1), 12))]
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for k in range(max(0, len(w) - 10) + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    expected = []
    for i, t in texts:
        w, hit, found = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for window, own in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= own
        expected.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    table = spark.createDataFrame(items, "item_id long, text string")
    same(winnow.contaminated_words(docs, table), expected, *names)
    assert winnow.decontaminated(docs, table).count() == sum(not e[-1] for e in expected)
    assert winnow.decontaminated(docs, table).columns == docs.columns
    assert winnow.contaminated_words(docs.limit(0), table).count() == 0
    assert winnow.contaminated_words(docs, table.limit(0)).filter("contaminated").count() == 0


def brute_factors(texts):
    """A row is judged against rows of smaller id (NULL is the largest) and earlier starts of its own; factors go on while their reference does."""
    place = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, t in texts:
        w = WORD.findall(t or "")
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            first[g] = min(first.get(g, (place(i), k)), (place(i), k))
    out = []
    for i, t in texts:
        w = WORD.findall(t or "")
        keep, own, found, last = [True] * len(w), {}, [], None
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            at = first[g] if first[g][0] < place(i) else (place(i), own[g]) if g in own else None
            own.setdefault(g, k)
            if at:
                keep[k : k + 20] = [False] * 20
                if last and at == (last[0], last[1] + 1):
                    found[-1][1] += 1
                else:
                    found.append([k, k + 20, None if at[0] == 1 << 62 else at[0], at[1]])
            last = at
        kept = " ".join(x for x, y in zip(w, keep) if y)
        out.append((i, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest(), kept, str(found)))
    return out


@pytest.mark.parametrize("size", [4_000_000, 50])
def test_factors(docs, texts, monkeypatch, size):
    monkeypatch.setattr(factors, "BLOCK_PHRASES", size)
    same(factors.without_repeats(docs), [e[:4] for e in brute_factors(texts)], "doc_id", "n_words", "n_removed", "kept_sha256")
    if size == 50:
        found = factors.without_repeats(docs, spans=True)
        listed = "concat('[', array_join(transform(factors, f -> concat('[', f.start, ', ', f.end, ', ', coalesce(string(f.reference), 'None'), ', ', f.reference_start, ']')), ', '), ']') AS found"
        same(found.selectExpr("*", listed), [e[:3] + e[4:] for e in brute_factors(texts)], "doc_id", "n_words", "n_removed", "kept_text", "found")
        assert factors.without_repeats(docs.limit(0)).count() == 0


def test_factors_follow_their_reference(spark, monkeypatch):
    monkeypatch.setattr(factors, "BLOCK_PHRASES", 100)
    rng = random.Random(5)
    a, b, c = (prose(rng, n).split() for n in (300, 200, 100_000))
    texts = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[40:100] + b[10:90])), (4, " ".join(a[:30] + b[:19] + a[30:60])), (5, " ".join(c)),
             (6, " ".join(c[-50:] + b[100:130] + c[:60])), (7, " ".join(["x"] * 60)), (8, " ".join(["x"] * 45))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = {r.doc_id: [tuple(f) for f in r.factors] for r in factors.without_repeats(docs, spans=True).collect()}
    brute = {e[0]: e[5] for e in brute_factors(texts)}
    assert {i: str([list(f) for f in fs]) for i, fs in found.items()} == brute
    assert (0, 60, 1, 40) in found[3] and (60, 140, 2, 10) in found[3]
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", F.lit(0).alias("place"), F.lit(0).alias("key"))
    assert factors.without_repeats(named).count() == 8


def brute_components(texts):
    sets = []
    for _, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(texts, sets))]


@pytest.mark.parametrize("size", [4_000_000, 100])
def test_similar_documents(docs, texts, monkeypatch, size):
    monkeypatch.setattr(jaccard, "BUCKET_POSTINGS", size)
    same(jaccard.similar_documents(docs), brute_components(texts), "doc_id", "n_shingles", "component_id")
    if size == 100:
        assert jaccard.similar_documents(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(a, a + 1) for a in range(1, 40)] + [(100, 120), (120, 110), (7, 7), (100, 120)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {a: 1 for a in range(1, 41)} | {100: 100, 110: 100, 120: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(spark, docs, texts):
    # One text for each id, as the order of rows that share an id is by hash.
    seen, own = set(), []
    for i, t in texts:
        if i is not None and i not in seen:
            seen.add(i)
            own.append((i, t))
    some, expected, earlier = spark.createDataFrame(own + own[:3], "doc_id long, text string"), [], []
    for i, t in sorted(own):
        kept = []
        for line in [] if t is None else t.split("\n"):
            s = frozenset(re.findall(r"[^ \t]+", line))
            if not s or not any(10 * len(s & e) >= 8 * len(s | e) for e in earlier):
                kept.append(line)
            if s:
                earlier.append(s)
        n = 0 if t is None else t.count("\n") + 1
        expected.append((i, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    expected += [e for e in expected if e[0] in (0, 1, 2)]
    same(lines.line_report(some), expected, "doc_id", "n_lines", "n_removed", "kept_sha256")
    every = lines.without_repeated_lines(docs)
    assert every.columns == docs.columns and every.count() <= docs.count()
    assert lines.line_report(docs).count() == docs.count()
    assert lines.line_report(docs.limit(0)).count() == 0


def test_quality_rules(docs, texts):
    expected = []
    for i, t in texts:
        w = WORD.findall(t or "")
        places = {}
        for k in range(len(w) - 4):
            places.setdefault(tuple(w[k : k + 5]), []).append(k)
        again = {x for p in places.values() if len(p) > 1 for k in p for x in range(k, k + 5)}
        own = [line for line in (t or "").split("\n") if WORD.search(line)]
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(own) - len(set(own)), len(again), failed))
    got = outliers.quality_rules(docs)
    same(got, expected, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got.filter("base_failed and kept").count() == 0
    assert outliers.quality_rules(docs.limit(0)).count() == 0


def test_outlier_is_rejected(spark):
    rng = random.Random(3)
    clean = [(i, prose(rng, rng.randrange(60, 200), 4000), "en", "a") for i in range(120)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(rng, 100, 4000).split()), "en", "a") for i in range(6)]
    got = {r["doc_id"]: r["kept"] for r in outliers.quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i] for i in range(6)) and sum(got[i] for i in range(120)) >= 119


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "benchmark", "pages")}


def held_out_accuracy(scores, labels, label):
    rows = scores.join(labels.dropDuplicates(["doc_id"]), "doc_id").filter("held_out").select("predicted", label).collect()
    return sum(a == b for a, b in rows) / len(rows)


def test_quality_ranking(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert held_out_accuracy(quality.quality_scores(documents, labels), labels, "quality") >= 0.95
    got = quality.quality_scores(docs, labels.limit(0))
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1 or predicted <> 1").count() == 0
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_toxicity(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    scored = toxicity.toxicity_scores(documents, labels).filter("held_out").join(labels, "doc_id")
    shares = {r["toxic"]: r["caught"] for r in scored.groupBy("toxic").agg(F.avg("predicted").alias("caught")).collect()}
    assert shares[1] >= 0.9 and shares[0] <= 0.01
    lexicon = toxicity.fit(documents, labels)
    found = toxicity.toxic_passages(documents.filter("doc_id < 500"), lexicon)
    assert found.filter("expected < 1 and `end` > start").count() == found.count() > 0
    got = toxicity.toxicity_scores(docs, labels.limit(0))
    assert got.count() == docs.count() and got.filter("predicted <> 0 or score is null").count() == 0


def test_clear_words_score_high():
    """More evidence never lowers the score of a toxic word, and one text without its own count is judged by the others."""
    def scores(n):
        toxic = toxicity._log_odds(np.array([float(n)]), np.array([0.0]), np.array([0.5]))
        return float(toxic[0])

    assert all(scores(a) < scores(b) for a, b in ((4, 40), (40, 4000), (4000, 400_000)))
    words = np.array([3], np.uint64), np.array([[1.0, 0.0]])
    lexicon = toxicity.Lexicon(*words, *words)
    token = type("T", (), {"hash": words[0], "heads": lambda self, k: words[0]})()
    assert lexicon.token_scores(token, np.array([1]))[0] == 0


def test_maximal_segments():
    # Every reported segment is maximal: no extension and no part does better; together they hold all positive scores.
    import numpy as np

    assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array([4.0, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]))] == [(0, 1), (2, 3), (4, 11)]
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = rng.normal(-0.3, 1, 40)
        sums = np.concatenate([[0], np.cumsum(s)])

        def split(low, high):
            best = max(((sums[b] - sums[a], a - b, a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0, 0))
            if best[0] <= 0:
                return []
            return split(low, best[2]) + [(best[2], best[3])] + split(best[3], high)

        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == split(0, 40)
    assert toxicity.maximal_segments(np.zeros(0)) == []


def test_languages(spark, docs):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = predict_languages(documents).filter("held_out").join(documents, "doc_id").select("lang_pred", "lang").collect()
    assert sum(a == b for a, b in got) / len(got) >= 0.97
    got = predict_languages(docs)
    assert got.count() == docs.count()
    assert {r[0] for r in got.join(docs.filter("text is null or trim(text) = ''").select("doc_id").distinct(), "doc_id").filter("doc_id <> 16").select("lang_pred").collect()} == {"und"}
    nothing = predict_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0] for r in nothing.select("lang_pred").distinct().collect()} == {"und"}
    assert predict_languages(docs.limit(0)).count() == 0


def test_packing(spark, docs, texts):
    got = packing.packed(docs, capacity=100, shard_pieces=20)
    rows = got.collect()
    n_words = sorted((i is None, i or 0, len(WORD.findall(t or ""))) for i, t in texts)
    assert sum(r["n_tokens"] for r in rows) == sum(n for *_, n in n_words)
    bins = {}
    for r in rows:
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
    for own in bins.values():
        assert sum(r["n_tokens"] for r in own) <= 100
        assert len({r["source"] for r in own}) == len(own)
        at = 0
        for r in sorted(own, key=lambda r: (r["start"], r["n_tokens"])):
            assert r["start"] == at
            at += r["n_tokens"]
    assert packing.packed(docs.limit(0)).count() == 0


def test_packing_parts_near_copies(spark, tmp_path):
    rng = random.Random(8)
    base = prose(rng, 80, 4000)
    rows = [(0, base, "a"), (1, base.replace(base.split()[40], "changed"), "b"), (2, "ÜNÏ cödé " * 3, "c"), (3, "\n\tünï CÖDÉ " * 3 + "\n", "d"), (4, prose(rng, 80, 4000), "e")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    own = {r["doc_id"]: (r["shard"], r["bin"]) for r in QUERIES["op3_conflict_packing"](spark, str(tmp_path)).collect()}
    assert len(own) == 5 and own[0] != own[1] and own[2] != own[3]
    plain = {r["doc_id"]: (r["shard"], r["bin"]) for r in packing.packed(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert plain[2] != plain[3]


def test_packing_is_best_fit():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    n = 400
    f = pd.DataFrame({"doc_id": np.arange(n), "piece": 0, "n_tokens": rng.integers(0, 60, n), "source": rng.choice(["a", "a", "b", "c", None], n),
                      "__cluster": rng.choice(["x", "y", "z", None], n, p=[0.1, 0.1, 0.1, 0.7]), "__row": 0, "shard": 0})
    got = packing.pack(f, 100)
    held = []  # the same rule, looking at all bins
    for r in got.itertuples():
        row = r._asdict()
        source, cluster = (None if pd.isna(row["source"]) else row["source"]), f.set_index("doc_id")["__cluster"][row["doc_id"]]
        fits = [(100 - b[0] - row["n_tokens"], k) for k, b in enumerate(held) if b[0] < 100 and b[0] + row["n_tokens"] <= 100 and source not in b[1] and (pd.isna(cluster) or cluster not in b[2])]
        number = got["__bin"][row["Index"]]
        if fits:
            assert 100 - held[number][0] - row["n_tokens"] == min(fits)[0] and number in [k for _, k in fits]
        else:
            assert number == len(held)
            held.append([0, set(), set()])
        assert got["start"][row["Index"]] == held[number][0]
        held[number][0] += row["n_tokens"]
        held[number][1].add(source)
        held[number][2] |= set() if pd.isna(cluster) else {cluster}


def test_warc(spark):
    tricky = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\nWARC/1.1"
    rows = [(1, "http://a/", "same"), (2, "http://b c/\r\nX: y", "same"), (7, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", tricky), (6, "u", "ünï" * 5000), (7, None, "same"), (8, "u", "alone"), (None, "u", "none")]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    last, expected = {}, []
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for i, _, h in rows:
        b = (h or "").encode()
        to = last[h or ""]
        again = i is not None and to != i
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", to if again else None))
    same(got, expected, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_keeps_repeated_rows(spark):
    rows = [(4, "u", "same")] * 2500 + [(3, "u", "same")] * 3 + [(None, None, None)] * 2 + [(1, "u", "alone")]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.select("capture_id").distinct().count() == len(rows)
    expected = [(4, 4, "response", None)] * 2500 + [(3, 4, "revisit", 4)] * 3 + [(None, 0, "response", None)] * 2 + [(1, 5, "response", None)]
    same(got, expected, "page_id", "payload_bytes", "record_type", "refers_to")


def test_warc_keeps_urls_apart(spark):
    rows = [(None, "u", "none"), (None, "v", "none"), (None, None, "none"), (1, "a", "same"), (1, "b", "same"), (0, "c", "same"), (None, "d", "same"), (None, "e", "same")]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    expected = [(None, 4, "response", None)] * 3 + [(1, 4, "response", None)] * 2 + [(0, 4, "revisit", 1)] + [(None, 4, "revisit", 1)] * 2
    same(got, expected, "page_id", "payload_bytes", "record_type", "refers_to")


def test_transactions_follow_chains(spark):
    fields = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_bytes long, fields string"
    rows = [("r", "response", None), ("q", "request", ["r"]), ("m", "metadata", ["q"]), ("m2", "metadata", ["m"]), ("lost", "request", ["gone"]), ("own", "metadata", None), ("s", "response", None)]
    records = spark.createDataFrame([(a, k, c, None, None, None, 1, None) for a, k, c in rows], fields)
    got = {r["capture_id"]: (r["response"] is not None, len(r["requests"] or []), len(r["metadata"] or [])) for r in warc.assemble(records).collect()}
    assert got == {"r": (True, 1, 2), "s": (True, 0, 0), "gone": (False, 1, 0), "own": (False, 0, 1)}
