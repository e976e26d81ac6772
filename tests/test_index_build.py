"""Building the word index: words are counted where their mail is, and no task's share grows with the table."""

import contextlib
import io
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailsift.functions.stem import count_tokens, stem_word
from mailsift.operators import bm25
from mailsift.storage import new_path

TEXTS = {"a": "the cargo cargoes delayed delay", "b": "", "c": None, "d": "of the", "e": "Vessel vessels été port", "f": "port " * 400}


@pytest.fixture(scope="module")
def mail(spark):
    return spark.createDataFrame(list(TEXTS.items()), "no string, plaintextbody string")


@pytest.mark.parametrize("stem", [True, False])
def test_counts_of_each_row(spark, stem):
    given = [("a", ["ports", "port", "delayed", "ports"]), ("b", []), ("c", None), ("d", ["port"])] + [
        (str(i), ["word"] * (i % 4) + [f"w{'x' * (i % 7)}"]) for i in range(50)]
    df = spark.createDataFrame(given, "no string, tokens array<string>").repartition(3)
    got = {r["no"]: (r["length"], {w["term"]: w["tf"] for w in r["words"]}) for r in count_tokens(df, "tokens", stem).collect()}
    assert got == {no: (len(t or []), Counter(stem_word(w) if stem else w for w in t or [])) for no, t in given}


def test_no_word_is_shuffled(mail):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        bm25.build_index(mail).postings.explain("formatted")
    assert "Exchange" not in text.getvalue()


def test_rows_of_one_key_and_length_count_as_one(spark, mail):
    twice = mail.unionByName(mail.where("no = 'a'")).unionByName(spark.createDataFrame([("a", "port")], mail.schema))
    index = bm25.build_index(twice)
    got = {(r["no"], r["length"], r["term"]): r["tf"] for r in index.postings.where("no = 'a'").collect()}
    assert got == {("a", 4, "cargo"): 4, ("a", 4, "delay"): 4, ("a", 1, "port"): 1} and index.postings.count() == 3 + 3 + 1
    assert sorted(r["length"] for r in index.docs.where("no = 'a'").collect()) == [1, 4, 4]


def test_files_grow_in_number_not_in_size(spark, mail, monkeypatch):
    monkeypatch.setattr(bm25, "DOCS_PER_FILE", 1)
    many = spark.range(60).select(F.col("id").cast("string").alias("no"), F.lit("customs port").alias("plaintextbody"))
    path = new_path(spark, "index")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows here are few
    try:
        bm25.write_index(bm25.build_index(many), path, buckets=4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = bm25.read_index(spark, path)
    files = stored.postings.groupBy(F.input_file_name().alias("file")).count().collect()
    assert max(r["count"] for r in files) < 60 and len({re.search(r"bucket=\d+", r["file"])[0] for r in files}) == 2
    assert stored.postings.count() == 120 and stored.totals() == (60, 2.0)


def test_a_word_is_shuffled_once_and_tasks_grow_with_the_hits(spark, monkeypatch):
    monkeypatch.setattr(bm25, "HITS_PER_TASK", 10)
    many = spark.range(60).select(F.col("id").cast("string").alias("no"), F.lit("customs port").alias("plaintextbody"))
    path = new_path(spark, "index")
    bm25.write_index(bm25.build_index(many), path, buckets=4)
    asked = spark.createDataFrame([(i, "customs") for i in range(5)], "query_id long, query_text string")
    scores = bm25.match_scores(bm25.read_index(spark, path), asked)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        scores.explain("simple")
    shuffles = re.findall(r"Exchange (\w+\(.*?\)), (\w+)", text.getvalue())
    assert [(re.sub(r"#\d+", "", s), kind) for s, kind in shuffles] == [("hashpartitioning(no, 32)", "REPARTITION_BY_NUM")]
    assert scores.count() == 300 and scores.select("bm25_score").distinct().count() == 1


def test_tasks_grow_with_the_files_whatever_the_session_says(spark, monkeypatch):
    monkeypatch.setattr(bm25, "DOCS_PER_FILE", 1)
    many = spark.range(60).select(F.col("id").cast("string").alias("no"), F.lit("customs port").alias("plaintextbody"))
    path = new_path(spark, "index")
    bm25.write_index(bm25.build_index(many), path, buckets=4)
    files = bm25.read_index(spark, path).postings.select(F.input_file_name()).distinct().count()
    assert files > 8  # two words, up to 16 files each
