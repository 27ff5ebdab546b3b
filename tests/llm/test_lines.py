"""Line dedup: which pairs of lines are compared at all."""

import random

from towline.llm import lines


def test_pairs_of_unlike_lines_are_not_compared(spark, monkeypatch):
    # All lines share their three rarest words and are unlike otherwise; one is a near copy of another.
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(80)]
    texts = [" ".join(["k1", "k2", "k3", *rng.sample(vocabulary, 37)]) for _ in range(60)]
    texts.append(texts[20].replace("k1", "k4"))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, " ".join(vocabulary * 100))]
    pairs, cut = [], lines.cut

    def counted(df):
        table = cut(df)
        if df.columns == ["line", "other"]:
            pairs.append(table.count())
        return table

    monkeypatch.setattr(lines, "cut", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r["doc_id"] for r in lines.line_report(docs).filter("n_removed > 0").collect()}
    assert gone == {60}
    assert sum(pairs) <= 2 * len(rows)  # all pairs of a list are 1,830
