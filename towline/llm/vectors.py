"""Vectors of a table as blocks of arrays, and blocks of rows met with blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.session import cut, spread

from .frames import BROADCAST_BYTES

QUERY_ROWS = 1024  # queries of a block, about


def finite(vector: Column) -> Column:
    """Whether a vector is there, and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def _matrices(table: pa.RecordBatch | pa.Table, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector; vectors hold no NULL."""
    lists = table.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lists = lists.cast(pa.large_list(lists.type.value_type))
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[offsets[rows][:, None] + np.arange(size)]


def _block(keys: list[str], columns: list[np.ndarray], matrix: np.ndarray) -> pa.RecordBatch:
    lists = [pa.array([c], pa.list_(pa.int64())) for c in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array([matrix.shape[1]], pa.int32()), *lists, pa.array([np.ascontiguousarray(matrix).tobytes()], pa.binary())], names=["dims", *keys, "data"])


def _schema(keys: list[str]) -> str:
    return ", ".join(["dims int", *(f"`{k}` array<bigint>" for k in keys), "data binary"])


def row_blocks(rows: DataFrame, keys: list[str], vector: str, block_rows: int) -> DataFrame:
    """Rows as blocks of at most `block_rows` vectors of one length: dims, each key as an array, and the vectors end to end.

    Keys are numbers without NULL. A block is made of rows of one partition, so nothing is shuffled.
    """
    source = spread(rows.select(*[F.col(k).cast("bigint").alias(k) for k in keys], vector))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            for at, matrix in _matrices(batch, vector):
                part = [*(c[at] for c in own), matrix]
                parts = held.setdefault(matrix.shape[1], [])
                while sum(len(p[-1]) for p in parts) + len(part[-1]) >= block_rows:
                    take = block_rows - sum(len(p[-1]) for p in parts)
                    *columns, whole = (np.concatenate(x) for x in zip(*parts, [x[:take] for x in part]))
                    yield _block(keys, columns, whole)
                    parts.clear()
                    part = [x[take:] for x in part]
                if len(part[-1]):
                    parts.append(part)
        for parts in held.values():
            if parts:
                *columns, whole = (np.concatenate(x) for x in zip(*parts))
                yield _block(keys, columns, whole)

    return source.mapInArrow(pack, _schema(keys))


def query_blocks(queries: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The same for queries, whose first key is unique: a written table of blocks of about QUERY_ROWS, dealt by hash."""
    n_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    source = queries.select(F.pmod(F.xxhash64(keys[0]), F.lit(n_blocks)).alias("__block"), *[F.col(k).cast("bigint").alias(k) for k in keys], vector)

    def pack(group: pa.Table) -> pa.Table:
        own = [group.column(k).to_numpy() for k in keys]
        return pa.Table.from_batches([_block(keys, [c[at] for c in own], matrix) for at, matrix in _matrices(group, vector)])

    return cut(source.groupBy("__block").applyInArrow(pack, _schema(keys)))


def met(blocks: DataFrame, queries: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every block with every block of queries of the same length; columns of the queries get the prefix `q_`.

    The query blocks are broadcast if their counted bytes are at most `limit`. Beyond that both sides are repeated and
    meet by numbers, a share of the queries and of the blocks at a time, so that no key holds more than a bounded number.
    """
    named = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    same = F.col("dims") == F.col("q_dims")
    size = queries.agg(F.sum(F.length("data") + 16 * F.size(queries.columns[1]))).first()[0] or 0
    if size <= limit:
        return blocks.join(F.broadcast(named), same)
    parts, groups = -(-size // limit), max(1, blocks.count() // 64)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = blocks.withColumn("__group", F.pmod(F.xxhash64("data"), F.lit(groups))).withColumn("__part", every(parts))
    right = named.withColumn("__part", F.pmod(F.xxhash64("q_data"), F.lit(parts))).withColumn("__group", every(groups))
    return left.join(right.hint("merge"), ["__group", "__part"]).filter(same).drop("__group", "__part")


def as_matrix(data: bytes, dims: int, like: np.dtype) -> np.ndarray:
    return np.frombuffer(data, like).reshape(-1, dims)
