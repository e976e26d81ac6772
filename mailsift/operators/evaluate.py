"""Retrieval quality: recall and reciprocal rank at k, reports per category, percentiles.

Results are (mode, query_id, no, position); the truth is a long table (query_id, no), so a query may expect any
number of mails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..storage import materialise
from .ranking import running_count


def read_query_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation queries from JSON lines (id, category, query, expected_nos): the queries and the long truth table."""
    schema = "id string, category string, query string, expected_nos array<string>, notes string"
    rows = spark.read.schema(schema).json(path)
    queries = rows.select(F.col("id").alias("query_id"), "category", F.col("query").alias("query_text"))
    return queries, rows.select(F.col("id").alias("query_id"), F.explode("expected_nos").alias("no"))


def scores(queries: DataFrame, results: DataFrame, truth: DataFrame, modes: list[str],
           k: int = C.EVAL_TOP_K) -> DataFrame:
    """Per mode and query: result count, recall@k and MRR@k; both are NULL for a query without truth.

    Results and truth are read twice each and stand for whole searches, so both are written once.
    """
    top = materialise(results.where(F.col("position") <= k), "results")
    asked = queries.select("query_id", "category", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    expected = materialise(truth.distinct(), "truth")
    wanted = expected.groupBy("query_id").agg(F.count("*").alias("expected"))
    found = top.groupBy("mode", "query_id").agg(F.count("*").alias("result_count"))
    hits = top.join(expected, ["query_id", "no"]).groupBy("mode", "query_id").agg(
        F.count("*").alias("hits"), F.min("position").alias("first_hit"))
    return (asked.join(wanted, "query_id", "left").join(found, ["mode", "query_id"], "left")
            .join(hits, ["mode", "query_id"], "left")
            .select("mode", "query_id", "category",
                    F.coalesce("result_count", F.lit(0)).alias("result_count"),
                    F.when(F.col("expected") > 0, F.coalesce("hits", F.lit(0)) / F.col("expected")).alias("recall"),
                    F.when(F.col("expected") > 0, F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr")))


def report(per_query: DataFrame) -> DataFrame:
    """Mean recall and MRR, query count and zero-result rate per mode and category, and over all categories."""
    empty = F.when(F.col("result_count") == 0, 1.0).otherwise(0.0)
    rows = per_query.rollup("mode", "category").agg(
        F.grouping("category").alias("_overall"), F.grouping("mode").alias("_all_modes"),
        F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.count("*").alias("queries"),
        F.avg(empty).alias("zero_result_rate"))
    return rows.where(F.col("_all_modes") == 0).withColumn(
        "category", F.when(F.col("_overall") == 1, "OVERALL").otherwise(F.col("category"))).drop(
        "_overall", "_all_modes")


def zero_result_rate(per_query: DataFrame, category: str = C.ZERO_RESULT_CATEGORY) -> DataFrame:
    """Share of the queries meant to find nothing that do find nothing, per mode."""
    return per_query.where(F.col("category") == category).groupBy("mode").agg(
        F.avg(F.when(F.col("result_count") == 0, 1.0).otherwise(0.0)).alias("zero_result_rate"))


def percentiles(df: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """Exact interpolated percentile of a measure per group, for groups of any size.

    Rows are counted per value, and the values at the two places around the percentile are picked by running counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    placed = running_count(counts, [group], [F.col("_value")], "_n", "_before", total="_filled")
    place = F.lit(share) * (F.col("_filled") - 1)
    ends = placed.groupBy(F.col(group).alias("_group")).agg(
        F.max(F.when(F.col("_before") <= F.floor(place), F.col("_value"))).alias("_low"),
        F.max(F.when(F.col("_before") <= F.ceil(place), F.col("_value"))).alias("_high"),
        F.max(place - F.floor(place)).alias("_part"))
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.join(ends, F.col(group).eqNullSafe(F.col("_group")), "left").select(
        group, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("p95"), "n")


def result_lists(queries: DataFrame, per_query: DataFrame, results: DataFrame, k: int = C.EVAL_TOP_K) -> DataFrame:
    """One row per mode and query with its ids in rank order, joined by `|`, for a CSV file."""
    ranked = results.where(F.col("position") <= k).groupBy("mode", "query_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "no"))).alias("hits"))
    ids = ranked.select("mode", "query_id", F.array_join("hits.no", "|").alias("nos"))
    return (per_query.join(queries.select("query_id", "query_text"), "query_id")
            .join(ids, ["mode", "query_id"], "left").withColumn("nos", F.coalesce("nos", F.lit(""))))
