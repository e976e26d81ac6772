"""The 3-gram index against a scan of all texts."""

import contextlib
import io
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailsift.operators import containment, exact, ngrams
from mailsift.storage import new_path

LETTERS = "abABc é–漢한😀-/ "


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    made = [(str(i), f, "".join(rng.choices(LETTERS, k=rng.choice([1, 2, 3, 4, 9, 40, 300]))))
            for i in range(120) for f in ("subject", "body")]
    made += [("n", "subject", None), ("e", "subject", ""), ("k", "body", "a"), ("s", "body", "ab"), (None, "body", "abc")]
    made += [(f"c{i}", "body", "the common text CASE-0042/7") for i in range(120)]  # grams of a third of all texts
    return made


@pytest.fixture(scope="module")
def texts(spark, rows):
    return spark.createDataFrame(rows, "key string, field string, text string").repartition(3)


@pytest.fixture(scope="module")
def path(spark, texts):
    made = new_path(spark, "grams-test")
    ngrams.write_grams(texts, made, forms=ngrams.FORMS, buckets=8, parts=2)
    return made


def terms_of(rows):
    rng = random.Random(9)
    found = {"", "zzz", "ab", "B", "漢", "😀", "a漢", "\0", "CASE-0042", "case00427", "common text case", "the common text CASE-0042/7x",
             "é–", " ", "  "}
    for _, _, text in rows:
        if text and rng.random() < 0.5:
            a = rng.randrange(len(text))
            found.add(text[a:a + rng.choice([1, 2, 3, 4, 5, 8, 30])])
    return sorted(found)


def lower(text):
    return text.lower()


def compacted(text):
    return re.sub("[^a-z0-9]", "", text.lower())


@pytest.mark.parametrize("form, shape, probes", [("lower", lower, 3), ("compact", compacted, 1)])
def test_the_index_finds_what_a_scan_finds(spark, rows, path, form, shape, probes):
    terms = terms_of(rows)
    given = spark.createDataFrame([(t,) for t in terms], "term string")
    got = [tuple(r) for r in ngrams.find_terms(ngrams.read_grams(spark, path), given, form=form, probes=probes).collect()]
    want = {(k, f, t.lower()) for k, f, text in rows if k and text for t in terms if shape(t) and shape(t) in shape(text)}
    assert set(got) == want and len(got) == len(want)
    some = [tuple(r) for r in ngrams.find_terms(ngrams.read_grams(spark, path), given, ["subject"], form).collect()]
    assert set(some) == {w for w in want if w[1] == "subject"}


def test_same_rows_as_the_scan_of_texts(spark, rows, texts, path):
    given = spark.createDataFrame([(t,) for t in terms_of(rows)], "term string")
    scan = containment.find_terms(texts.where("key is not null"), given)
    assert sorted(ngrams.find_terms(ngrams.read_grams(spark, path), given).collect()) == sorted(scan.collect())


def test_extension_equals_a_full_build(spark, rows, texts):
    made = new_path(spark, "grams-test")
    half = F.pmod(F.hash("key"), F.lit(2)) == 0
    ngrams.write_grams(texts.where(half), made, buckets=4, parts=2)
    for _ in range(2):  # the second time nothing is new
        ngrams.extend_grams(spark, made, texts)
    full = new_path(spark, "grams-test")
    ngrams.write_grams(texts, full, buckets=4, parts=2)
    grown, whole = ngrams.read_grams(spark, made), ngrams.read_grams(spark, full)
    assert sorted(grown.grams.collect()) == sorted(whole.grams.collect())
    given = spark.createDataFrame([(t,) for t in terms_of(rows)], "term string")
    assert sorted(ngrams.find_terms(grown, given).collect()) == sorted(ngrams.find_terms(whole, given).collect())


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_only_asked_folders_are_read(spark, path):
    index = ngrams.read_grams(spark, path)
    wanted = ngrams.lookups(index, spark.createDataFrame([("case-0042",)], "term string"))
    buckets = sorted(r.bucket for r in wanted.select("bucket").distinct().collect())
    assert len(buckets) <= 3
    postings = ngrams.asked_postings(index, wanted, "lower")
    files = [r[0] for r in postings.select(F.input_file_name()).distinct().collect()]
    assert {int(re.search(r"bucket=(\d+)", f).group(1)) for f in files} == set(buckets)
    plan = plan_of(postings)
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(", plan) or len(buckets) == 1
    assert "PushedFilters: [" in plan and "gram" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_no_text_is_read_where_nothing_matches(spark, path, texts):
    index = ngrams.read_grams(spark, path)
    found = ngrams.find_terms(index, spark.createDataFrame([("no such words",), ("ab",)], "term string"))
    assert "texts" not in plan_of(found) and found.where("term = 'no such words'").isEmpty()


def test_a_form_that_was_not_built(spark, texts):
    made = new_path(spark, "grams-test")
    ngrams.write_grams(texts.limit(3), made, buckets=2, parts=2)
    with pytest.raises(ValueError):
        ngrams.find_terms(ngrams.read_grams(spark, made), spark.createDataFrame([("a",)], "term string"), form="compact")


def test_empty_tables(spark, texts, path):
    made = new_path(spark, "grams-test")
    ngrams.write_grams(texts.where("false"), made, buckets=2, parts=2)
    given = spark.createDataFrame([("abc",), ("a",)], "term string")
    assert ngrams.find_terms(ngrams.read_grams(spark, path), given.where("false")).collect() == []
    assert ngrams.find_terms(ngrams.read_grams(spark, made), given).collect() == []


def test_exact_search_by_index_and_by_scan(spark):
    mail = spark.createDataFrame(
        [(str(i), f"subject {i}", f"body LPO-{i % 7} of case {i % 5}", f"CASE-{i % 4:04d}", "2025-01-01 08:00:00") for i in range(60)],
        "no string, subject string, plaintextbody string, hvdc_cases string, deliverytime string")
    queries = spark.createDataFrame([(1, "lpo 3"), (2, "case-0002"), (3, "mail 17"), (4, "case-9999")],
                                    "query_id long, query_text string")
    made = new_path(spark, "grams-test")
    ngrams.write_grams(containment.text_fields(mail, "no", ["subject", "plaintextbody", "hvdc_cases"]), made, buckets=4, parts=2)
    index = ngrams.read_grams(spark, made)
    allowed = mail.where("cast(no as int) % 3 != 0").select("no")
    for some in (None, allowed):
        by_scan = exact.exact_search(mail, queries, 10, some)
        by_index = exact.exact_search(mail, queries, 10, some, index)
        assert sorted(by_index.collect()) == sorted(by_scan.collect())
        assert by_scan.count() > 5


def grams_of(text):
    pieces = {text[i:i + n] for i in range(len(text)) for n in (1, 2, 3)}
    return {int(g) for piece in pieces if piece for g in ngrams.gram_numbers(piece)}


def test_packed_postings_in_small_slices(monkeypatch, rows):
    """A row per gram, slice and field, however the texts fall into batches, chunks, slices and segments."""
    monkeypatch.setattr(ngrams, "CHARS_AT_ONCE", 50)
    monkeypatch.setattr(ngrams, "PAIRS_AT_ONCE", 400)
    given = [("lower", f, 1 + i // 150, i % 150, t) for i, (_, f, t) in enumerate(rows) if t]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("form", "field", "chunk", "place", "text"), r)) for r in given[a:a + 40]])
               for a in range(0, len(given), 40)]
    out = [r for b in ngrams._pack(iter(batches)) for r in b.to_pylist()]
    names = [(r["form"], r["field"], r["gram"], r["chunk"], r["slice"]) for r in out]
    assert len(set(names)) == len(names) and len({n[3:] for n in names}) > 10
    assert all(r["n"] == len(r["places"]) and r["places"] == sorted(set(r["places"])) for r in out)
    got = [(r["field"], r["gram"], r["chunk"], p) for r in out for p in r["places"]]
    assert len(got) == len(set(got))
    assert set(got) == {(f, g, c, p) for _, f, c, p, t in given for g in grams_of(t)}


def test_postings_are_lists_of_a_chunk(spark):
    """Index and candidates have rows per gram and chunk, not per gram and text, and a repeated text comes back once."""
    texts = spark.range(400).selectExpr("cast(id % 399 as string) AS key", "'body' AS field", "concat('the same words ', id % 2) AS text")
    made = new_path(spark, "grams-test")
    ngrams.write_grams(texts.coalesce(2), made, buckets=2, parts=2)
    index = ngrams.read_grams(spark, made)
    assert index.postings.count() <= 2 * index.grams.count() and index.postings.agg(F.sum("n")).first()[0] > 10_000
    given = spark.createDataFrame([("same words 1",), ("e",)], "term string")
    assert ngrams.candidates(index, ngrams.lookups(index, given)).count() <= 4
    found = ngrams.find_terms(index, given).groupBy("term").count()
    assert {r["term"]: r["count"] for r in found.collect()} == {"same words 1": 200, "e": 399}
