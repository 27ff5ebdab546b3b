"""Boxes by an index against the chain of rules."""

import random

from towline.functions import classify_boxes
from towline.operators.regions import box_table, classify_by_boxes


def test_index_equals_chain(spark, rows):
    rng = random.Random(3)
    rules = [("world", []), ("north", [("lat", ">", 30)]), ("point", [("lat", "=", 5), ("lon", "=", 5)]), ("none", [("lat", ">", 3), ("lat", "<", 2)])]
    for k in range(60):
        low, left = rng.randint(-90, 80), rng.randint(-180, 170)
        size = rng.choice([0.5, 2, 7, 60])
        rules.append((f"b{k}", [("lat", rng.choice([">", ">="]), low), ("lat", rng.choice(["<", "<="]), low + size), ("lon", ">=", left), ("lon", "<", left + 3 * size)]))
    spots = [(rng.randint(-95, 95), rng.randint(-185, 185)) for _ in range(300)] + [(5, 5), (1000, 1000), (None, 3), (40, None), (None, None)] + [(5, 5)] * 3
    df = spark.createDataFrame([(i, None if a is None else float(a), None if b is None else float(b)) for i, (a, b) in enumerate(spots)], "id int, lat double, lon double")
    for some in (rules, rules[4:], rules[:1], rules[2:4]):
        got = classify_by_boxes(df, "lat", "lon", box_table(spark, some))
        assert rows(got) == rows(classify_boxes(df, "lat", "lon", some))


def test_no_boxes_and_no_points(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, lat double, lon double")
    assert classify_by_boxes(df, "lat", "lon", box_table(spark, [])).first()["region"] is None
    assert classify_by_boxes(df.limit(0), "lat", "lon", box_table(spark, [("a", [])])).count() == 0
