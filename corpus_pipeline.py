"""The corpus pipeline: quality, line dedup, near duplicates, benchmark decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from towline.llm.frames import bounded, table
from towline.llm.jaccard import clusters
from towline.llm.lines import without_repeated_lines
from towline.llm.packing import packed
from towline.llm.quality import keep_good
from towline.llm.winnow import decontaminated
from towline.session import checkpoint_folder, cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking scores at 0.7 or more; it is fitted on the labelled documents of the whole table."""
    return keep_good(docs, table(spark, sf_dir, "labels"), fit_on=table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; those without any line left go. `n_chars` follows the text."""
    kept = without_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of similar ones: that with the least doc_id, NULL last, and then the least hash of its text.
    Rows are judged one by one, so rows that share an id but no text stay. Rows without words are similar to none and stay."""
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__key").alias("key"))
    first = F.col("doc_id").eqNullSafe(F.col("least.id")) & (F.col("__key") == F.col("least.key"))
    rows = clusters(keyed, ["doc_id", "__key"], place).filter("cluster is not null")
    rows = cut(rows.groupBy(F.col("doc_id").alias("__id"), F.col("__key").alias("__of"), first.alias("__first")).count())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of"))
    kept = keyed.join(bounded(cut(rows.filter("not __first").select("__id", "__of")), 24), same, "left_anti")
    # Rows with the id and text of the first one: the least of their other columns.
    repeated = bounded(cut(rows.filter("__first and count > 1").select("__id", "__of")), 24)
    once = kept.join(repeated, same, "left_anti").drop("__key")
    again = kept.join(repeated, same, "left_semi").groupBy("doc_id", "__key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.union(again.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their bins."""
    return packed(docs)


STAGES = [
    ("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("packing", packing),
]

# Fitted scores and packing have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again for the next one."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
