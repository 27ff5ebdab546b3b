"""Small helpers around DataFrames of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import blocks

BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(
    docs: DataFrame, keep: list[str], make: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], fields: str, text: str = "text"
) -> DataFrame:
    """Columns `keep` and one array per entry of `fields`, which `make(bytes, offsets)` gives for a block of texts."""
    names = [field.split()[0] for field in fields.split(",")]
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "__text"):
                n = rows.stop - rows.start
                kept = [batch.column(c).slice(rows.start, n) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in make(data, offsets))], names=[*keep, *names])

    return source.mapInArrow(run, schema)


def bounded(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its rows take at most `limit` bytes; else left to a shuffled join.

    `row_bytes` is the size of every row, or an expression for that of each.
    """
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    if size > limit:
        return df
    small = F.broadcast(df)
    small._written_to = getattr(df, "_written_to", None)  # so that it can be dropped like the table itself
    return small


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document is in the part of the documents that no label may be learnt from. NULL ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, limit: int) -> DataFrame:
    """At most `limit` documents with a label that may be learnt from: (doc_id, y, text).

    The documents are those with the least hash of their id among all that have one undisputed label. A document
    that is repeated counts once, with its least text.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), parts, part))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("__y"))
        .filter("y = __y").select("doc_id", "y")
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most `limit` pairs of two numbers: safe to broadcast at any size of the corpus.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
