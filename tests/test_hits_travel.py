"""Searches at size: what is shuffled does not depend on the size of the mail table's files."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from catalog import ranked
from mailsift import session
from mailsift.operators import bm25


@pytest.fixture
def large_tables(spark):
    """As with large tables, Spark broadcasts nothing by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("simple")
    return re.sub(r"#\d+", "", text.getvalue())


def test_postings_of_other_mails_are_not_shuffled(spark, large_tables):
    mails = spark.range(40).select(F.col("id").cast("string").alias("no"), F.lit("customs port").alias("plaintextbody"))
    allowed = mails.where("no < '2'").select("no")
    asked = spark.createDataFrame([(1, "customs")], "query_id long, query_text string")
    found = bm25.search(bm25.build_index(mails), asked, 100, allowed)
    text = plan(found)
    assert "SortMergeJoin [no]" not in text and text.count("hashpartitioning(no") == 1
    # the join with the allowed mails stands below the shuffle
    assert text.index("hashpartitioning(no") < text.index("BroadcastHashJoin [no]")
    assert {r.no for r in found.collect()} == {r.no for r in allowed.collect()}


def test_more_allowed_mails_than_can_be_broadcast(spark, large_tables, monkeypatch):
    mails = spark.range(40).select(F.col("id").cast("string").alias("no"), F.lit("customs port").alias("plaintextbody"))
    allowed = mails.where("no < '2'").select("no")
    asked = spark.createDataFrame([(1, "customs"), (2, "port")], "query_id long, query_text string")
    index = bm25.build_index(mails)
    few = bm25.search(index, asked, 100, allowed).collect()
    monkeypatch.setattr(bm25, "is_small", lambda df, limit=5: df.limit(limit + 1).count() <= limit)
    assert sorted(few) == sorted(bm25.search(index, asked, 100, allowed.union(allowed)).collect())


@pytest.mark.parametrize("query", [ranked.rerank_full, ranked.hybrid_search, ranked.filtered_hybrid_search])
def test_mails_are_not_shuffled_for_their_hits(spark, sf_dir, large_tables, query):
    assert "hashpartitioning(no" not in plan(query(spark, sf_dir))


def test_tasks_read_a_bounded_part(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    for given, kept in (("128m", str(session.READ_BYTES)), ("134217728b", str(session.READ_BYTES)), ("1g", str(session.READ_BYTES)),
                        ("4m", "4m"), ("1024", "1024")):
        spark.conf.set(key, given)
        session.bounded_reads(spark)
        assert int(spark.conf.get(key).rstrip("bm")) == int(kept.rstrip("m"))
    spark.conf.set(key, before)
