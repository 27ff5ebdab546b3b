"""Connected components by hooking and pointer jumping; every table stays in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.session import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b), with the least node of its component as root.

    Each round hooks every node to its least neighbour if that is smaller, follows the pointers to the end of their
    chains, and replaces both ends of each edge by their roots. Rounds shrink the graph until no edge joins two roots.
    NULL ends, loops and repeated edges are ignored.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    left = cut(edges.filter("a <> b").select(most.alias("a"), least.alias("b")).distinct())
    roots = None
    while not left.isEmpty():
        written = hooks = cut(left.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("__up"))
            jumped = cut(hooks.join(up, "root", "left").select("node", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("__moved")))
            drop(written)
            hooks, written = jumped.select("node", "root"), jumped
            if jumped.filter("__moved").isEmpty():
                break
        if roots is None:
            low = left.select(F.col("b").alias("node")).distinct().join(hooks, "node", "left_anti").select("node", F.col("node").alias("root"))
            roots = cut(hooks.union(low))
        else:
            before, roots = roots, cut(_through(roots, hooks, "root"))
            drop(before)
        moved = _through(_through(left, hooks, "a"), hooks, "b").filter("a <> b")
        shrunk = cut(moved.select(most.alias("a"), least.alias("b")).distinct())
        drop(left, written)
        left = shrunk
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _through(rows: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    """`rows` with `column` replaced by its root where it has one."""
    to = hooks.select(F.col("node").alias(column), F.col("root").alias("__root"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("__root", column)).select(*rows.columns)
