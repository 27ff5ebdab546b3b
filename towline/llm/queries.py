"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_warc_transactions": oracles.WARC, "op4_winnowing": oracles.WINNOW, "op8_lempel_ziv_factors": oracles.FACTORS,
    "op9_divide_skip_join": oracles.SIMILAR, "op11_periodic_runs": oracles.RUNS, "op12_vantage_points": oracles.NEAREST,
    "op13_hard_negatives": oracles.NEGATIVES,
}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .outliers import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


@query
def op9_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


@query
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import contaminated_words

    return contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_lempel_ziv_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .factors import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


@query
def op10_line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_report

    return line_report(table(spark, sf_dir, "documents"))


@query
def op3_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), near=True)


@query
def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark, table(spark, sf_dir, "pages")).drop("capture_id")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs

    docs = table(spark, sf_dir, "documents")
    return periodic_runs(docs, planted=F.crc32(F.col("doc_id").cast("string").cast("binary"))).drop("n_words")


@query
def op12_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vptree import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), factor=1.0)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives
    from .vectors import finite

    vectors = table(spark, sf_dir, "embeddings").filter(finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))
