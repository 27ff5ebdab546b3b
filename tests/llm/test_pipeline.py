"""The pipeline's stages against plain Python, each on what the stage before it kept."""

import re

import corpus_pipeline as pipeline
from test_operators import ALNUM, LOWER, WORD, brute_components

SF = "/root/testdata/sf0.001"


def kept_lines(rows):
    """Earlier lines judge later ones, on the input."""
    earlier, out = [], []
    for i, t in sorted(rows):
        lines = []
        for line in t.split("\n"):
            s = frozenset(re.findall(r"[^ \t]+", line))
            if not s or not any(10 * len(s & e) >= 8 * len(s | e) for e in earlier):
                lines.append(line)
            if s:
                earlier.append(s)
        if lines:
            out.append((i, "\n".join(lines)))
    return out


def windows(text):
    w = ALNUM.findall(text.translate(LOWER))
    return {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results.append(docs)
        if name != "packing":
            assert docs.columns == columns
    rows = [[(r["doc_id"], r["text"]) for r in df.collect()] for df in results[:-1]]
    every = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = dict(rows[0])
    assert all(every[i] == t for i, t in first.items())
    assert sum((i in first) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)

    assert sorted(rows[1]) == kept_lines(rows[0])
    assert results[1].filter("n_chars <> length(text)").count() == 0

    components = brute_components(rows[1])
    assert sorted(rows[2]) == sorted((i, t) for (i, t), (_, _, c) in zip(rows[1], components) if c == i)

    items = set().union(*(windows(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    assert sorted(rows[3]) == sorted((i, t) for i, t in rows[2] if not windows(t) & items)

    packed = results[-1].collect()
    assert sum(r["n_tokens"] for r in packed) == sum(len(WORD.findall(t)) for _, t in rows[3])
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows[3]}


def test_near_duplicates_by_row(spark):
    text = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    near = text[0].replace("a20", "changed")
    rows = [(1, text[0], "x"), (2, near, "x"), (2, text[1], "x"), (3, text[2], "x"), (3, text[3], "x"), (3, text[3], "y"), (3, text[3], "x"),
            (None, text[2], "x"), (None, "n " + text[1], "x"), (None, "m1 m2 m3 m4 m5 m6", "x"), (None, "m1 m2 m3 m4 m5 m6", "x"), (None, None, "x"), (None, "", "x")]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), SF)
    expected = [rows[0], rows[2], rows[3], rows[4], rows[9], rows[11], rows[12]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
