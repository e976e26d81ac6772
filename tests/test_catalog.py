"""Every registered query against its SQL, and the shape of the plans."""

import contextlib
import io
import re

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.common import TABLES

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return made


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        result = db.execute(ORACLE[name])
        assert got == ordered([c[0] for c in result.description], result.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "no", "bm25_score", "position"]


@pytest.mark.parametrize("name", [
    "bm25_search", "exact_search", "rerank_full", "vector_topk", "vector_topk_blocks", "similar_docs", "network_edges",
    "sender_history", "case_places", "link_parts", "rrf_score", "containment_pairs"])
def test_no_cross_join_and_no_single_task(spark, sf_dir, name):
    text = io.StringIO()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with contextlib.redirect_stdout(text):
            QUERIES[name](spark, sf_dir).explain("simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = text.getvalue()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan and "BatchEvalPython" not in plan
    assert all(keys.strip() for keys in re.findall(r"Window \[.*?\], \[(.*?)\]", plan))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'").groupBy("user_id").count().explain(
            "formatted")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in text.getvalue()
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text.getvalue()
