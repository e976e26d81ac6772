"""Operators against brute force, on small tables with one very large group."""

import contextlib
import io
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions.stem import stem_word
from mailsift.operators import (analytics, attachments, bilingual, bm25, containment, evaluate, exact, filters, fusion,
                                incremental, joins, ranking, threads, vectors)
from mailsift.plans import search as plans
from mailsift.sources import manifest, tables
from mailsift.storage import new_path
from mailsift.streaming import ingest

WORDS = ["customs", "clearance", "vessel", "port", "delay", "invoice", "crane", "cargo", "the", "of", "packing", "lists"]


@pytest.fixture(scope="module")
def mails():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        body = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))
        rows.append({
            "no": str(i), "subject": f"{rng.choice(WORDS)} {i}", "sendername": f"user{i % 3}",
            "senderemail": "hot@a.example.com" if i % 3 else f"u{i}@b.example.com", "recipientto": "x@y.example.org",
            "plaintextbody": body + (" LPO-77" if i % 10 == 0 else ""), "company_name": "Acme" if i % 2 else None,
            "hvdc_cases": f"CASE-{i % 4:04d}", "primary_case": "CASE-HOT" if i % 3 else f"C{i}",
            "deliverytime": f"2025-01-{i % 28 + 1:02d} 08:00:00" if i % 11 else "unknown", "month": "202501",
            "site": "AGI", "stage": None, "linkkey": f"{i:012x}"})
    return rows


@pytest.fixture(scope="module")
def mail(spark, mails):
    return spark.createDataFrame(pd.DataFrame(mails).astype(object).where(lambda d: d.notna(), None), ", ".join(
        f"{c} string" for c in mails[0])).repartition(4)


def plain_bm25(mails, query):
    def tokens(text):
        cleaned = "".join(ch if ch.isascii() and ch.isalpha() else " " for ch in text.lower())
        return [stem_word(w) for w in cleaned.split() if w not in C.STOP_WORDS]

    docs = {m["no"]: tokens(" ".join(m[f] or "" for f in C.INDEX_FIELDS)) for m in mails}
    mean = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in set(tokens(query)):
        df = sum(term in d for d in docs.values())
        for no, d in docs.items():
            tf = d.count(term)
            if tf:
                idf = math.log10((len(docs) - df + 0.5) / (df + 0.5) + 1)
                scores[no] = scores.get(no, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return {no: round(s, 6) for no, s in scores.items()}


def test_bm25_stored_index_and_salted_join(spark, mail, mails, monkeypatch):
    path = new_path(spark, "index")
    bm25.write_index(bm25.build_index(mail), path, buckets=4)
    index = bm25.read_index(spark, path)
    queries = spark.createDataFrame([(1, "customs delay"), (2, "The crane of 7"), (3, "nowhere"), (4, "")],
                                    "query_id long, query_text string")
    for limit in (joins.SMALL_ROWS, 0):
        monkeypatch.setattr(joins, "is_small", lambda df, n, limit=limit: limit > 0)
        got = {(r.query_id, r.no): round(r.bm25_score, 6) for r in bm25.match_scores(index, queries).collect()}
        want = {(q, no): s for q, text in ((1, "customs delay"), (2, "The crane of 7"))
                for no, s in plain_bm25(mails, text).items()}
        assert got == want


def test_a_search_reads_the_folders_of_its_words_only(spark, mail):
    path = new_path(spark, "index")
    bm25.write_index(bm25.build_index(mail), path, buckets=16)
    one = spark.createDataFrame([(1, "customs")], "query_id long, query_text string")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        bm25.match_scores(bm25.read_index(spark, path), one).explain("formatted")
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = \d+\)\]", text.getvalue())


def test_index_extension_equals_a_full_build(mail):
    old = mail.where("cast(no as int) < 50")
    grown = bm25.extend_index(bm25.build_index(old), mail)
    full = bm25.build_index(mail)
    assert sorted(grown.terms.collect()) == sorted(full.terms.collect())
    assert sorted(grown.postings.collect()) == sorted(full.postings.collect())
    again = bm25.extend_index(grown, mail)
    assert again.docs.count() == full.docs.count()


def test_exact_search(spark, mail, mails):
    queries = spark.createDataFrame([(1, "lpo 77"), (2, "case-0002"), (3, "7"), (4, "2025"), (5, "mail 0042, 1177")],
                                    "query_id long, query_text string")
    rows = exact.exact_search(mail, queries, 200).collect()
    found = {q: {r.no for r in rows if r.query_id == q} for q in range(1, 6)}
    assert found[1] == {m["no"] for m in mails if "LPO-77" in m["plaintextbody"]}
    assert found[2] == {m["no"] for m in mails if m["hvdc_cases"] == "CASE-0002"}
    assert found[3] == set() and found[4] == set()
    assert {r.exact_tier for r in rows if r.query_id == 1} == {2} and {r.exact_tier for r in rows if r.query_id == 2} == {1}
    assert all(r.match_reason == "exact identifier, body" for r in rows if r.query_id == 1)
    ranks = sorted(r.exact_rank for r in rows if r.query_id == 2)
    assert ranks == list(range(1, len(ranks) + 1))


def test_ids_are_tier_zero(spark, mail):
    queries = spark.createDataFrame([(1, "CASE 0001")], "query_id long, query_text string")
    renamed = mail.withColumn("no", F.when(F.col("no") == "5", "CASE-0001").otherwise(F.col("no")))
    tiers = {r.no: r.exact_tier for r in exact.exact_search(renamed, queries, 200).collect()}
    assert tiers.pop("CASE-0001") == 0 and set(tiers.values()) == {1}


def test_terms_over_several_scans(spark, mail, mails):
    terms = spark.createDataFrame([(w,) for w in ["Customs", "customs clear", "port delay", "zz", "é", ""]], "term string")
    for per_scan in (100, 2):
        hits = containment.find_terms(containment.text_fields(mail, "no", ["plaintextbody"]), terms, per_scan).collect()
        want = {(m["no"], "plaintextbody", t) for m in mails for t in ("customs", "customs clear", "port delay")
                if t in m["plaintextbody"].lower()}
        assert {tuple(r) for r in hits} == want and len(hits) == len(want)


def plain_nearest(queries, held, k):
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    v = held / np.linalg.norm(held, axis=1, keepdims=True)
    scores = np.round(q @ v.T, 9)
    return {i: sorted(range(len(held)), key=lambda j: (-scores[i, j], str(j)))[:k] for i in range(len(queries))}


def test_nearest_with_many_copies(spark):
    rng = np.random.default_rng(1)
    held = rng.standard_normal((300, 8)).astype("float32")
    held[100:200] = held[0]  # a third of the rows are copies
    queries = np.concatenate([held[:5], rng.standard_normal((20, 8))]).astype("float32")
    v = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(held)], "no string, vector array<float>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_id long, vector array<float>")
    want = plain_nearest(queries.astype("float64"), held.astype("float64"), 7)
    for pairs in (vectors.candidate_pairs(q, v.repartition(5), 7),
                  vectors.candidate_pairs(q, v, 7, block_rows=16, broadcast_queries=0)):
        rows = vectors.best_pairs(pairs, 7).orderBy("query_id", "position").collect()
        got = {i: [int(r.no) for r in rows if r.query_id == i] for i in range(len(queries))}
        assert got == want
    near = vectors.nearest_approximate(q, v, 7, 8, tables=12, bits=4, block_rows=16)
    exact_hits = vectors.nearest(q, v, 7)
    assert vectors.recall_against(near, exact_hits).first()["recall"] > 0.9


def test_vectors_without_values(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0])], "no string, vector array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.no, r.cosine_score) for r in vectors.nearest(q, v, 5).collect()] == [("a", 1.0), ("c", 0.0)]
    assert vectors.nearest(q, v, 5, min_score=0.5).count() == 1


def test_embedding(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None), (4, "Beta ALPHA alpha")], "i int, t string")
    rows = {r.i: np.array(r.vector) for r in vectors.embed(df, "t", width=16).collect()}
    assert np.linalg.norm(rows[1]) == pytest.approx(1) and not rows[2].any() and not rows[3].any()
    assert (rows[1] == rows[4]).all()
    own = vectors.embed(df, "t", encoder=lambda texts: [[1.0, 2.0]] * len(texts)).collect()
    assert all(list(r.vector) == [1.0, 2.0] for r in own)


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(5)
    rows = [(("hot" if i % 3 else f"g{i % 7}"), str(i), rng.choice([None, rng.randint(0, 40) / 4, 3.0])) for i in range(600)]
    return spark.createDataFrame(rows, "g string, no string, v double").repartition(6)


@pytest.fixture(params=[10**6, 20])
def rows_per_task(request, monkeypatch):
    """With few rows per task, the keys of the test tables count as heavy."""
    monkeypatch.setattr(joins, "ROWS_PER_TASK", request.param)


def test_ranks_of_a_large_group(hot, rows_per_task):
    frame = hot.toPandas()
    for ascending in (True, False):
        got = ranking.competition_rank(hot, ["g"], "v", "r", ascending, buckets=8).toPandas().set_index("no").r
        want = frame.groupby("g").v.rank(method="min", ascending=ascending).set_axis(frame.no)
        pd.testing.assert_series_equal(got.sort_index().astype(float), want.sort_index(), check_names=False)


def test_scaling(hot, rows_per_task):
    frame = hot.toPandas()
    got = ranking.scale_min_max(hot, ["g"], "v", "s").toPandas().set_index("no").s
    filled = frame.assign(v=frame.v.fillna(0))
    low, high = filled.groupby("g").v.transform("min"), filled.groupby("g").v.transform("max")
    want = ((filled.v - low) / (high - low)).set_axis(frame.no)
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([("a", "1", 5.0), ("a", "2", 5.0), ("b", "3", 0.0), ("c", "4", None)],
                               "g string, no string, v double")
    got = {r.no: r.s for r in ranking.scale_min_max(df, ["g"], "v", "s").collect()}
    assert got == {"1": 1.0, "2": 1.0, "3": 0.0, "4": 0.0}


def test_rrf_bounds(hot):
    rows = fusion.rrf(hot.withColumnRenamed("g", "query_id"), "v", "s").collect()
    assert all(0 <= r.s <= 1 / 61 and (r.s == 0) == (r.v is None) for r in rows)


def test_positions_and_first_rows(hot):
    frame = hot.toPandas()
    placed = ranking.position_in_group(hot, ["g"], [F.col("no")], F.substring("no", 1, 1), "p", size="n").toPandas()
    want = frame.sort_values("no").groupby("g").cumcount().add(1).set_axis(frame.sort_values("no").no)
    pd.testing.assert_series_equal(placed.set_index("no").p.sort_index().astype("int64"), want.sort_index(), check_names=False)
    assert (placed.n == placed.groupby("g").no.transform("count")).all()
    first = {r.g: r.no for r in ranking.keep_first(hot, ["g"], F.col("no")).collect()}
    assert first == frame.groupby("g").no.min().to_dict()


def test_recency(spark):
    rows = [("q", "1", "2025-01-03 01:00:00"), ("q", "2", "2025-01-02 23:00:00"), ("q", "3", "2025-01-01"), ("q", "4", "soon"),
            ("r", "5", "soon"), ("s", "6", "2025-01-01"), ("s", "7", "2025-01-01")]
    df = spark.createDataFrame(rows, "query_id string, no string, deliverytime string")
    got = {r.no: round(r.recency_score, 6) for r in fusion.recency(df).collect()}
    assert got == {"1": 1.0, "2": 1.0, "3": round(1 - 2 / 9999, 6), "4": 0.0, "5": 0.0, "6": 1.0, "7": 1.0}


def test_rerank_keeps_every_candidate(spark, mail, mails):
    index = bm25.build_index(mail)
    queries = spark.createDataFrame([(1, "customs delay"), (2, "case-0001 crane")], "query_id long, query_text string")
    ranked = plans.keyword_search(mail, index, queries, 15)
    rows = ranked.collect()
    for q in (1, 2):
        mine = [r for r in rows if r.query_id == q]
        assert sorted(r.position for r in mine) == list(range(1, len(mine) + 1))
        assert len({r.no for r in mine}) == len(mine)
    tiers = [r.exact_tier for r in sorted((r for r in rows if r.query_id == 2), key=lambda r: r.position)]
    assert tiers[0] == 1 and tiers == sorted(tiers, key=lambda t: 9 if t is None else t)
    shown = plans.presented(ranked, mail, queries).collect()
    assert len(shown) == len(rows) and all("****@" in r.senderemail for r in shown)


def test_search_routes(spark, mail):
    index = bm25.build_index(mail)
    queries = spark.createDataFrame([(1, "통관 서류"), (2, "ustoms zzz"), (3, "zzz"), (4, "rane")],
                                    "query_id long, query_text string")
    rows = plans.keyword_search(mail, index, queries, 10).collect()
    modes = {r.query_id: r["mode"] for r in rows}
    assert modes == {1: "glossary", 2: "ilike_fb", 4: "ilike_fb"}
    assert {r["mode"] for r in bilingual.route(queries).collect()} == {"glossary", "bm25"}
    assert bilingual.key_decisions(mail, index, "delay", 10).count() == 10


SPEC = {"field": "subject", "op": "ilike", "value": "x"}


@pytest.mark.parametrize("spec", [
    {"filters": [SPEC] * 9}, {"filters": [{**SPEC, "value": "x" * 201}]}, {"filters": [{**SPEC, "value": True}]},
    {"filters": [{**SPEC, "value": None}]}, {"filters": [{**SPEC, "field": "password"}]},
    {"filters": [{**SPEC, "op": "like"}]}, {"where": "1=1"}, {"sql": "select 1", "filters": []}, "month = 1", None,
    {"filters": [{**SPEC, "op": "in", "value": []}]}, {"filters": [{**SPEC, "op": "in", "value": ["x"] * 21}]},
    {"filters": [{**SPEC, "op": "between", "value": ["a"]}]}, {"filters": ["x"]}, {"filters": "x"},
    {"logic": "xor", "filters": [SPEC]}])
def test_refused_specifications(spark, spec):
    with pytest.raises(ValueError):
        filters.compile_filter(spec)


def test_accepted_specifications(mail):
    assert filters.compile_filter({"filters": []}) is None
    assert filters.apply_filter(mail, {}).count() == 120
    assert filters.apply_filter(mail, {"filters": [{"field": "sendername", "op": "in", "value": ["user1", "user2"]}]}).count() == 80
    assert filters.apply_filter(mail, {"filters": [{"field": "subject", "op": "ilike", "value": "%"}]}).count() == 0
    assert filters.apply_filter(mail, {"filters": [{"field": "subject", "op": "ilike", "value": "_"}]}).count() == 0
    assert filters.refine(mail, "user[12]").count() == 80 and filters.refine(mail, "user[12]", literal=True).count() == 0


def test_threads(spark, mail, mails, rows_per_task):
    seeds = spark.createDataFrame([("1",), ("3",)], "no string")
    thread = threads.case_thread(mail, seeds).collect()
    assert {r.no for r in thread} == {m["no"] for m in mails if m["primary_case"] in ("CASE-HOT", "C3")}
    history = threads.sender_history(mail, seeds, 5).collect()
    assert len([r for r in history if r.seed == "1"]) == 5 and not any(r.no == r.seed for r in history)
    hot_rows = threads.case_threads(mail).where("primary_case = 'CASE-HOT'").orderBy("place").collect()
    assert [r.place for r in hot_rows] == list(range(1, 81))


def test_incremental(spark):
    held = spark.createDataFrame([("1",), ("2",)], "no string")
    incoming = spark.createDataFrame([("2", 1), ("3", 5), ("3", 4), (None, 1)], "no string, o int")
    fresh = incremental.new_rows(incoming, held, "no", F.col("o"))
    assert [tuple(r) for r in fresh.collect()] == [("3", 4)]
    assert incremental.new_rows(incoming, held.union(fresh.select("no")), "no", F.col("o")).count() == 0
    table = spark.createDataFrame([("1",), ("2",)], "no string")
    staged = spark.createDataFrame([("2", [1.0])], "no string, e array<double>")
    assert {r.no: r.e for r in incremental.update_column(table, staged, "no", "e").collect()} == {"1": None, "2": [1.0]}


def test_attachments(spark, tmp_path, rows_per_task):
    listing = tmp_path / "listing"
    listing.mkdir()
    (listing / "a.json").write_text('{"files": [{"id": "f1", "title": "fff2f051e10c_b.pdf"},\n'
                                    '{"id": "f2", "title": "fff2f051e10c_a.pdf"}, {"id": "f3", "title": "other.pdf"}]}')
    (listing / "b.json").write_text('{"files": [{"id": "f1", "title": "fff2f051e10c_b.pdf"},'
                                    '{"id": "f4", "title": "0123456789ab.pdf"}]}')
    (tmp_path / "extra.json").write_text('{"0123456789ab": [{"id": "f5", "title": "zz"}]}')
    files = attachments.keyed_files(attachments.read_listings(spark, str(listing)))
    both = attachments.apply_overrides(files, attachments.read_overrides(spark, str(tmp_path / "extra.json")))
    links = attachments.with_links(attachments.link_map(both))
    got = {(r.linkkey, r.position): (r.id, r.label) for r in links.collect()}
    assert got == {("fff2f051e10c", 1): ("f2", "PDF part 1"), ("fff2f051e10c", 2): ("f1", "PDF part 2"),
                   ("0123456789ab", 1): ("f4", "PDF part 1"), ("0123456789ab", 2): ("f5", "PDF part 2")}
    mails = spark.createDataFrame([("1", "fff2f051e10c"), ("2", "0123456789ab"), ("3", "ffffffffffff"), ("4", None)],
                                  "no string, linkkey string")
    assert sorted((r.no, r.id) for r in attachments.attach(mails, links).collect() if r.id) == [
        ("1", "f1"), ("1", "f2"), ("2", "f4"), ("2", "f5")]
    assert sorted(r.no for r in attachments.attach(mails, links).collect() if not r.id) == ["3", "4"]
    texts = spark.createDataFrame([(1, "None", "see fff2f051e10c"), (2, "x", "https://x/?id=" + "a" * 25),
                                   (3, None, "nothing")], "doc int, a string, b string")
    found = attachments.resolve_links(texts, "doc", ["a", "b"], links)
    assert {(r.doc, r.id) for r in found.collect()} == {(1, "f2"), (1, "f1"), (2, "a" * 25)}


def test_evaluation(spark):
    queries = spark.createDataFrame([(1, "x", "a"), (2, "x", "a"), (3, "zero_result", "b")],
                                    "query_id long, category string, query_text string")
    results = spark.createDataFrame([("m", 1, str(i), i) for i in range(1, 12)] + [("m", 2, "9", 1)],
                                    "mode string, query_id long, no string, position int")
    truth = spark.createDataFrame([(1, "4"), (1, "11"), (2, "77")], "query_id long, no string")
    rows = {r.query_id: (r.result_count, r.recall, r.mrr) for r in evaluate.scores(
        queries, results, truth, ["m"]).collect()}
    assert rows == {1: (10, 0.5, 0.25), 2: (1, 0.0, 0.0), 3: (0, None, None)}
    report = {r.category: r for r in evaluate.report(evaluate.scores(queries, results, truth, ["m"])).collect()}
    assert report["OVERALL"].recall == 0.25 and report["zero_result"].recall is None and report["x"].queries == 2
    assert evaluate.zero_result_rate(evaluate.scores(queries, results, truth, ["m"])).first().zero_result_rate == 1.0


def test_query_set(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"id": "q1", "category": "x", "query": "alpha", "expected_nos": ["1", "2"]}\n'
                                     '{"id": "q2", "category": "x", "query": "beta", "expected_nos": []}\n')
    queries, truth = evaluate.read_query_set(spark, str(tmp_path / "q.json"))
    assert queries.count() == 2 and sorted(map(tuple, truth.collect())) == [("q1", "1"), ("q1", "2")]


def test_sources(spark, mail, tmp_path):
    assert tables.clean_names(["No.", "Sender Name", "", "sender-name", None]) == [
        "no", "sender_name", "col_unknown", "sender_name_4", "col_unknown_5"]
    assert tables.has_values(mail, "subject") and not tables.has_values(mail, "stage")
    assert not tables.has_values(mail, "embedding") and not tables.has_table(spark, "no_such_table")
    good, empty = tmp_path / "good.bin", tmp_path / "empty.bin"
    good.write_bytes(b"abc")
    empty.write_bytes(b"")
    files = manifest.delivered_files(spark, str(tmp_path))
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    wanted = spark.createDataFrame(
        [("good.bin", digest.upper(), 10), ("good.bin", digest, 2), ("empty.bin", "", 0), ("gone.bin", "x", 0)],
        "name string, sha256 string, max_bytes long")
    assert sorted(map(tuple, manifest.violations(files, wanted).collect())) == [
        ("empty.bin", "missing or empty"), ("empty.bin", "no checksum given"), ("gone.bin", "missing or empty"),
        ("good.bin", "too large")]
    assert manifest.missing_tables(spark, ["no_such_table"]) == ["no_such_table"]


def test_stream_can_be_resumed(spark, tmp_path):
    schema = "no string, subject string, sendername string, company_name string, plaintextbody string, arrived timestamp"
    landing, out, chunks, check = (str(tmp_path / d) for d in ("landing", "mail", "chunks", "check"))

    def deliver(ids):
        (spark.createDataFrame([(i, "None", "s", None, "body " * 300) for i in ids], schema.rsplit(",", 1)[0])
         .withColumn("arrived", F.lit("2025-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(landing))

    deliver(["1", "2.0", "2", "nan"])
    ingest.load_mail(spark, landing, spark.read.parquet(landing).schema, out, chunks, check)
    assert sorted(r.no for r in spark.read.parquet(out).collect()) == ["1", "2"]
    deliver(["2", "3"])
    ingest.load_mail(spark, landing, spark.read.parquet(landing).schema, out, chunks, check)
    assert sorted(r.no for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]
    sections = spark.read.parquet(chunks).where("no = '3'").orderBy("section").select("section", "chunk_text").collect()
    assert [s.section for s in sections] == ["body_0", "body_1", "body_2", "body_3", "header"]
    assert sections[-1].chunk_text == "s"


def test_network(mail):
    edges = analytics.network_edges(mail)
    assert [tuple(r) for r in edges.collect()] == [("Acme", "y", 60)]
    assert {r.node: r.degree for r in analytics.node_degrees(edges.withColumn("target", F.col("source"))).collect()} == {"Acme": 2}


def mail_rows(spark, rows):
    """A mail table from dictionaries; columns that a row does not name are NULL."""
    names = list(dict.fromkeys([*C.RESULT_COLUMNS, "plaintextbody", "primary_case"]))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def test_filters_apply_before_the_cut(spark):
    rows = [{"no": str(i), "subject": "crane", "plaintextbody": "crane CASE-0007 " * (61 - i),
             "deliverytime": f"2025-01-01 {i // 60:02d}:{i % 60:02d}:00"} for i in range(60)]
    table = mail_rows(spark, rows)
    allowed = spark.createDataFrame([(str(i),) for i in range(30, 60)], "no string")
    index = bm25.build_index(table)
    queries = spark.createDataFrame([("q1", "crane"), ("q2", "case-0007"), ("q3", "ran"), ("q4", "통관 crane")],
                                    "query_id string, query_text string")
    found = plans.keyword_search(table, index, queries, 10, allowed=allowed).collect()
    assert {q: sum(r.query_id == q for r in found) for q in ("q1", "q3")} == {"q1": 10, "q3": 10}
    assert {r.query_id for r in found} >= {"q1", "q2", "q3"} and all(int(r.no) >= 30 for r in found)
    assert bm25.match_counts(bm25.match_scores(index, queries.where("query_id = 'q1'")), allowed).first().matches == 30


def test_best_tier_is_never_cut(spark):
    rows = [{"no": "CASE-0007", "subject": "old", "deliverytime": "2020-01-01 00:00:00"}] + [
        {"no": str(i), "subject": "new", "plaintextbody": "see CASE-0007", "deliverytime": "2025-01-01 00:00:00"}
        for i in range(20)]
    queries = spark.createDataFrame([(1, "CASE-0007")], "query_id long, query_text string")
    found = exact.exact_search(mail_rows(spark, rows), queries, 3).orderBy("exact_rank").collect()
    assert [r.exact_tier for r in found] == [0, 2, 2] and found[0].no == "CASE-0007"


def test_ranks_with_an_outlier(spark):
    values = [float(i // 2) for i in range(400)] + [1e15, None]
    df = spark.createDataFrame([("g", str(i), v) for i, v in enumerate(values)], "g string, no string, v double")
    got = ranking.competition_rank(df, ["g"], "v", "r", True).toPandas().set_index("no").r
    want = pd.Series(values, [str(i) for i in range(len(values))]).rank(method="min")
    pd.testing.assert_series_equal(got.sort_index().astype(float), want.sort_index(), check_names=False)


def test_percentiles(spark):
    groups = {"a": [5.0], "b": [1.0, 1.0, 9.0, 2.5, None], None: [float(i % 7) for i in range(200)], "c": [None]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double")
    got = {r.g: (r.p95, r.n) for r in evaluate.percentiles(df, "g", "v").collect()}
    for g, values in groups.items():
        filled = [v for v in values if v is not None]
        assert got[g][1] == len(values)
        assert got[g][0] == (pytest.approx(np.percentile(filled, 95)) if filled else None)


def test_places_in_an_undated_case(spark):
    rows = [{"no": str(i), "primary_case": "C", "deliverytime": "unknown" if i % 3 else "2025-01-01 00:00:00"} for i in range(90)]
    got = {r.no: r.place for r in threads.case_threads(mail_rows(spark, rows)).collect()}
    want = sorted(range(90), key=lambda i: (i % 3 > 0, i))
    assert got == {str(no): place for place, no in enumerate(want, 1)}


def test_files_with_equal_title_heads(spark):
    titles = [f"fff2f051e10c_document_number_{i:03d}.pdf" for i in range(50)]
    files = spark.createDataFrame([("fff2f051e10c", str(i), t) for i, t in enumerate(titles)],
                                  "linkkey string, id string, title string")
    rows = attachments.link_map(files).collect()
    assert {r.title: r.position for r in rows} == {t: i for i, t in enumerate(titles, 1)} and {r.files for r in rows} == {50}


def test_ids_that_are_no_numbers(spark):
    v = spark.createDataFrame([("m1", [1.0, 0.0]), ("m2", [0.9, 0.1]), ("m3", [0.0, 1.0])], "no string, vector array<float>")
    found = vectors.similar_documents(v, 1).collect()
    assert {(r.query_id, r.no) for r in found} == {("m1", "m2"), ("m2", "m1"), ("m3", "m2")}
    work = vectors.scored_share(v.withColumnRenamed("no", "query_id"), v, 2, 2, tables=2, bits=1).first()
    assert work.scored == 18 and work.share == 2.0  # one bit, two probes: every pair, in both tables


def test_export_cells_with_line_breaks(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text('Title,\n,\n"x",\nNo.,Body\n1,"line one\nline two"\nNo.,Body\n2,"said ""no"",\n\n twice "\n,\n')
    rows = tables.read_export(spark, str(path)).collect()
    assert [(r["no"], r["body"]) for r in rows] == [
        ("1", "line one\nline two"), ("No.", "Body"), ("2", 'said "no",\n\n twice ')]
