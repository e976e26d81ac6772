"""Evaluation: searches and truth are worked out once, however often the scores read them."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mailsift.operators import evaluate


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("simple")
    return text.getvalue()


@pytest.mark.parametrize("name", ["eval_export"])
def test_no_search_is_left_in_the_plan(spark, sf_dir, name):
    assert not {w for w in ("MapInPandas", "MapInArrow", "bm25_score", "cosine_score") if w in plan(entry.queries()[name](spark, sf_dir))}


def test_results_and_truth_run_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    queries = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "query_id long, category string")
    results = spark.createDataFrame([("m", 1, "x", 1), ("m", 1, "y", 2), ("m", 2, "x", 1)],
                                    "mode string, query_id long, no string, position int").mapInArrow(
        counted, "mode string, query_id long, no string, position int")
    truth = spark.createDataFrame([(1, "y"), (1, "y"), (2, "z")], "query_id long, no string").mapInArrow(
        counted, "query_id long, no string")
    got = evaluate.scores(queries, results, truth, ["m"]).orderBy("query_id").select(
        "result_count", "recall", "mrr", F.lit(0)).collect()
    assert [tuple(r)[:3] for r in got] == [(2, 1.0, 0.5), (1, 0.0, 0.0), (0, None, None)] and runs.value == 6
