"""Nearest neighbours by vantage-point trees, one tree per shard of the rows.

A shard is a block of rows of one partition. Its tree splits the rows at the median distance from a vantage point, and
keeps for both halves the least and the greatest of these distances; by the triangle inequality a row of a half is at
least as far from a query as the query's own distance falls outside that range. A half is left out when this bound, times
`factor`, exceeds the distance of the k-th best row so far: factor 1 is exact, and a greater one leaves out more.

All queries of a block go through a tree together. First each descends to its own leaf, which gives good distances to
prune by; then the nodes are visited once each with the queries that still need them. Answers found in one shard prune in
the following ones of the same task. Within a leaf a matrix product gives distances up to rounding, and only those that
may be among the best are computed again, component by component, as the measure is defined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from towline.session import cut

from .vectors import as_matrix, finite, met, query_blocks, row_blocks

SHARD_ROWS = 8192
LEAF_ROWS = 64
_SLACK = 1e-9  # of the numbers in a bound, far more than their rounding errors


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of rows of `a` to the rows of `b` beside them, summed from the first component to the last."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for k in range(a.shape[1]):
            gap = a[:, k].astype(np.float64) - b[:, k]
            total += gap * gap
    return np.sqrt(total)


@dataclass
class Tree:
    """Nodes in preorder. A leaf holds rows[low:high]; another node its vantage point, its children and their ranges of distances."""

    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    vantage: np.ndarray  # -1 in a leaf
    inner: np.ndarray
    outer: np.ndarray
    ranges: np.ndarray  # (nodes, 4): least and greatest distance of the inner, then of the outer half


def _to(point: np.ndarray, points: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(((points.astype(np.float64) - point) ** 2).sum(-1))


def build(matrix: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    rows = np.arange(len(matrix))
    nodes: list[list] = []

    def grow(low: int, high: int) -> int:
        me = len(nodes)
        nodes.append([low, high, -1, -1, -1, (0.0, 0.0, 0.0, 0.0)])
        if high - low > leaf_rows:
            own = rows[low:high]
            # The row farthest from another one lies at the edge, where distances spread most.
            vantage = own[np.argmax(_to(matrix[own[0]], matrix[own]))]
            away = _to(matrix[vantage], matrix[own])
            order = np.argsort(away, kind="stable")
            rows[low:high], away = own[order], away[order]
            middle = (high - low) // 2
            nodes[me][2], nodes[me][5] = vantage, (away[0], away[middle - 1], away[middle], away[-1])
            nodes[me][3] = grow(low, low + middle)
            nodes[me][4] = grow(low + middle, high)
        return me

    grow(0, len(matrix))
    low, high, vantage, inner, outer, ranges = zip(*nodes)
    return Tree(rows, *(np.array(x) for x in (low, high, vantage, inner, outer)), np.array(ranges))


class Search:
    """The best rows so far for each query of a block: distances and ids, nearest first, ties by id."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, factor: float):
        self.ids, self.matrix, self.k, self.factor = ids, matrix, k, factor
        self.wide = matrix.astype(np.float64)
        self.square = (self.wide**2).sum(1)
        self.distance = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.measured = 0  # pairs of a query and a row in a leaf

    def shard(self, ids: np.ndarray, matrix: np.ndarray, tree: Tree) -> None:
        """Go through the tree of a shard with all queries."""
        wide = matrix.astype(np.float64)
        square = (wide**2).sum(1)
        done = np.full(len(self.ids), -1)  # the leaf that a query has seen in its first descent

        def leaf(node: int, queries: np.ndarray) -> None:
            rows = tree.rows[tree.low[node] : tree.high[node]]
            self._measure(queries, ids[rows], matrix[rows], wide[rows], square[rows])

        def descend(node: int, queries: np.ndarray) -> None:
            if tree.vantage[node] < 0:
                leaf(node, queries)
                done[queries] = node
                return
            own = _to(wide[tree.vantage[node]], self.wide[queries])
            inside = own <= (tree.ranges[node, 1] + tree.ranges[node, 2]) / 2
            for child, chosen in ((tree.inner[node], queries[inside]), (tree.outer[node], queries[~inside])):
                if len(chosen):
                    descend(child, chosen)

        def visit(node: int, queries: np.ndarray) -> None:
            if tree.vantage[node] < 0:
                queries = queries[done[queries] != node]
                if len(queries):
                    leaf(node, queries)
                return
            own = _to(wide[tree.vantage[node]], self.wide[queries])
            for child, (least, most) in ((tree.inner[node], tree.ranges[node, :2]), (tree.outer[node], tree.ranges[node, 2:])):
                with np.errstate(invalid="ignore"):
                    bound = np.maximum(own - most, least - own) - _SLACK * (own + most)
                    near = queries[~(bound * self.factor > self.distance[queries, -1])]
                if len(near):
                    visit(child, near)

        if len(ids):
            every = np.arange(len(self.ids))
            descend(0, every)
            visit(0, every)

    def _measure(self, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, wide: np.ndarray, square: np.ndarray) -> None:
        self.measured += len(queries) * len(ids)
        limit = self.distance[queries, -1]
        with np.errstate(over="ignore", invalid="ignore"):
            about = self.square[queries][:, None] + square[None, :]
            rough = about - 2 * (self.wide[queries] @ wide.T)
            near = ~(rough - _SLACK * about > (limit**2)[:, None]) & (self.ids[queries][:, None] != ids[None, :])
        q, r = np.nonzero(near)
        if not len(q):
            return
        away = exact_distances(self.matrix[queries[q]], matrix[r])
        # Of the rows that may enter, those of one query stand together: rank them, then merge the first k.
        order = np.lexsort((ids[r], away, q))
        q, r, away = q[order], r[order], away[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        q, r, away, rank = (x[rank < self.k] for x in (q, r, away, rank))
        into = np.unique(q)
        slot = np.searchsorted(into, q)
        distance = np.full((len(into), 2 * self.k), np.inf)
        found = np.full((len(into), 2 * self.k), np.iinfo(np.int64).max)
        distance[:, : self.k], found[:, : self.k] = self.distance[queries[into]], self.found[queries[into]]
        distance[slot, self.k + rank], found[slot, self.k + rank] = away, ids[r]
        # A distance may overflow to infinity: a place without a row comes after it by its id.
        best = np.lexsort((found, distance), axis=1)[:, : self.k]
        self.distance[queries[into]] = np.take_along_axis(distance, best, 1)
        self.found[queries[into]] = np.take_along_axis(found, best, 1)


_TREE = "rows binary, low binary, high binary, vantage binary, inner binary, outer binary, ranges binary"
_PARTS = ("rows", "low", "high", "vantage", "inner", "outer", "ranges")


def index(vectors: DataFrame, id: str, vector: str, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """A written table with one row per shard: its ids, its vectors and its tree. Every row of `vectors` is in one shard.

    Rows without id and vectors that are NULL, zero, or hold NULL or a non-finite component are left out.
    """
    used = vectors.select(F.col(id).cast("bigint").alias("ids"), F.col(vector).alias("__vector")).filter(
        F.col("ids").isNotNull() & finite(F.col("__vector")) & F.exists("__vector", lambda x: x != 0))
    kind = _dtype(vectors, vector)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                tree = build(as_matrix(one.column("data")[0].as_buffer(), one.column("dims")[0].as_py(), kind), leaf_rows)
                parts = [pa.array([getattr(tree, p).astype(np.float64 if p == "ranges" else np.int32).tobytes()], pa.binary()) for p in _PARTS]
                yield pa.RecordBatch.from_arrays([*one.columns, *parts], names=[*one.schema.names, *_PARTS])

    return cut(row_blocks(used, ["ids"], "__vector", shard_rows).mapInArrow(grow, f"dims int, ids array<bigint>, data binary, {_TREE}"))


def _dtype(vectors: DataFrame, vector: str) -> np.dtype:
    return np.dtype({"float": np.float32, "double": np.float64, "int": np.int32, "bigint": np.int64}[vectors.schema[vector].dataType.elementType.simpleString()])


def nearest(vectors: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 10, factor: float = 1.0,
            shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` rows of `vectors` nearest to each row of `queries` by Euclidean distance.

    Nearest first, ties by smaller id; all candidates, if they are fewer. The score is the distance in double precision of the vectors
    as they stand. A query meets every row with another id and a vector as long as its own. Rows without id and vectors
    that are NULL, zero, or hold NULL or a non-finite component take no part, as row or as query. Repeated rows
    are candidates each; of queries with the same id, the one with the least vector asks. Other columns are not read. Empty tables give an
    empty result. A `factor` above 1 searches less and may miss neighbours; what it misses depends on how the rows are laid out.
    """
    if factor < 1:
        raise ValueError("factor must be at least 1")
    asked = queries.select(F.col(id).cast("bigint").alias("ids"), F.col(vector).alias("__vector")).filter(
        F.col("ids").isNotNull() & finite(F.col("__vector")) & F.exists("__vector", lambda x: x != 0)).groupBy("ids").agg(F.min("__vector").alias("__vector"))
    shards = index(vectors, id, vector, shard_rows, leaf_rows)
    pairs = met(shards, query_blocks(asked, ["ids"], "__vector"))
    kind, q_kind = _dtype(vectors, vector), _dtype(queries, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[int, Search] = {}

        def found() -> Iterator[pa.RecordBatch]:
            for search in searches.values():
                q, at = np.nonzero(search.found < np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(search.ids[q]), pa.array(search.found[q, at]), pa.array(search.distance[q, at])], names=["query_id", "vec_id", "score"])
            searches.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda name: batch.column(name)[i]  # noqa: B023, E731
                q_ids = cell("q_ids").values.to_numpy()
                key = int(q_ids[0])  # ids of queries are unique, so the first one names the block
                if key not in searches:
                    if len(searches) >= 64:
                        yield from found()
                    searches[key] = Search(q_ids, as_matrix(cell("q_data").as_buffer(), cell("q_dims").as_py(), q_kind), k, factor)
                parts = [np.frombuffer(cell(p).as_buffer(), np.float64 if p == "ranges" else np.int32) for p in _PARTS]
                parts[-1] = parts[-1].reshape(-1, 4)
                searches[key].shard(cell("ids").values.to_numpy(), as_matrix(cell("data").as_buffer(), cell("dims").as_py(), kind), Tree(*parts))
        yield from found()

    answers = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
