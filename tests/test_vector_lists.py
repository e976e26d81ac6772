"""Chunk searches that fill k, and the inverted-file index, against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.operators import inverted_file, vectors
from mailsift.storage import new_path


def unit(m):
    return m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))


def plain(queries, held, names, k):
    scores = np.round(unit(queries.astype("float64")) @ unit(held.astype("float64")).T, 9)
    return {i: sorted(((-scores[i, j], names[j]) for j in range(len(held))))[:k] for i in range(len(queries))}


def found(df, column="no"):
    rows = df.orderBy("query_id", "position").collect()
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((-r.cosine_score, r[column]))
    return out


def tables(spark, queries, held, names):
    return (spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_id long, vector array<float>"),
            spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, held)], "no string, vector array<float>").repartition(4))


# --- mails by their best chunk ---------------------------------------------------------------------------------

@pytest.mark.parametrize("limits", [dict(), dict(block_rows=16, broadcast_queries=0)])
def test_k_mails_come_back_where_k_exist(spark, limits):
    rng = np.random.default_rng(2)
    chunks = rng.standard_normal((260, 6)).astype("float32")
    chunks[:80] = chunks[0]  # one mail owns the best chunks; ties
    chunks[80:90] = chunks[0]  # other mails own copies of them
    owners = ["big"] * 80 + [f"m{i % 7}" for i in range(180)]
    ids = [f"{o}_{i:03d}" for i, o in enumerate(owners)]
    queries = np.concatenate([chunks[:2], rng.standard_normal((9, 6))]).astype("float32")
    table = spark.createDataFrame([(o, c, "body", f"text {c}", x.tolist()) for o, c, x in zip(owners, ids, chunks)],
                                  "no string, chunk_id string, section string, chunk_text string, vector array<float>")
    asked = tables(spark, queries, chunks[:1], ["x"])[0]
    scores = np.round(unit(queries.astype("float64")) @ unit(chunks.astype("float64")).T, 9)
    got = vectors.nearest_by_chunk(asked, table.repartition(3), 5, **limits).collect()
    want = {}
    for q in range(len(queries)):
        best = {}
        for o, c, s in zip(owners, ids, scores[q]):
            best[o] = min(best.get(o, (9.0, "")), (-s, c))
        want[q] = [(o, c, -s) for o, (s, c) in sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:5]]
    for q, rows in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.position)
        assert [(r.no, r.chunk_id, r.cosine_score) for r in mine] == rows and len(mine) == 5
        assert all(r.chunk_text == f"text {r.chunk_id}" for r in mine)
    few = vectors.nearest_by_chunk(asked, table, 5, overfetch=10)
    assert few.where("query_id = 0").count() < 5  # the option: mails among the best 50 chunks only
    allowed = spark.createDataFrame([("m1",), ("m2",)], "no string")
    assert {r.no for r in vectors.nearest_by_chunk(asked, table, 5, allowed=allowed, **limits).collect()} == {"m1", "m2"}


def test_no_chunks_and_no_queries(spark):
    table = spark.createDataFrame([("a", "c", "s", "t", None)],
                                  "no string, chunk_id string, section string, chunk_text string, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")
    assert vectors.nearest_by_chunk(asked, table, 5).collect() == []
    assert vectors.nearest_by_chunk(asked.where("false"), table, 5).collect() == []


# --- inverted file ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 16))
    held = (centres[rng.integers(0, 40, 4000)] + 0.25 * rng.standard_normal((4000, 16))).astype("float32")
    held[1000:2300] = held[0]  # a third of the rows are copies
    held[5] = 0
    return held, [f"{i:05d}" for i in range(len(held))]


@pytest.fixture(scope="module")
def index(spark, clustered):
    held, names = clustered
    path = new_path(spark, "lists-test")
    vectors_ = tables(spark, held[:1], held, names)[1].unionByName(
        spark.createDataFrame([("null", None)], "no string, vector array<float>"))
    inverted_file.write_lists(vectors_, path, lists=40, sample_rows=2000, buckets=8)
    return inverted_file.read_lists(spark, path)


def test_recall_at_a_quarter_of_the_pairs(spark, clustered, index):
    held, names = clustered
    queries = held[2300:2500]
    asked = tables(spark, queries, held[:1], names)[0]
    want = plain(queries, held, names, 10)
    got = found(inverted_file.nearest_by_lists(asked, index, 10, probes=4))
    recall = sum(len({s[1] for s in got[q]} & {s[1] for s in want[q]}) for q in want) / (10 * len(want))
    share = inverted_file.probed_share(asked, index, 4)
    assert recall >= 0.9 and share <= 0.25, (recall, share)


@pytest.mark.parametrize("block_rows", [4096, 200])
def test_exact_search_equals_brute_force(spark, clustered, index, block_rows):
    held, names = clustered
    rng = np.random.default_rng(1)
    queries = np.concatenate([held[:6], held[2400:2420], rng.standard_normal((5, 16)), np.zeros((1, 16))]).astype("float32")
    asked = tables(spark, queries, held[:1], names)[0]
    got = inverted_file.nearest_by_lists(asked, index, 10, probes=1, exact=True, block_rows=block_rows)
    assert found(got) == plain(queries, held, names, 10)


def test_exact_search_among_allowed_mails(spark, clustered, index):
    held, names = clustered
    asked, _ = tables(spark, held[2400:2405], held[:1], names)
    some = [0, 7, 3999, 2401]
    allowed = spark.createDataFrame([(names[i],) for i in some], "no string")
    got = inverted_file.nearest_by_lists(asked, index, 10, probes=1, exact=True, allowed=allowed)
    assert found(got) == plain(held[2400:2405], held[some], [names[i] for i in some], 10)


def test_only_folders_of_asked_lists_are_read(spark, clustered, index):
    asked, _ = tables(spark, clustered[0][2400:2401], clustered[0][:1], clustered[1])
    probed = inverted_file._probed(index, asked, 2)
    lists = {r.list for r in probed.collect()}
    plan = inverted_file._scored(index, probed, 10, None, 4096)._jdf.queryExecution().toString()
    folders = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert len(lists) == 2
    assert {int(x) for x in (folders.group(1) or folders.group(2)).split(",")} == {x % 8 for x in lists}


def test_the_sample_is_bounded_and_spread(spark, clustered):
    held, names = clustered
    made = inverted_file.train_centroids(tables(spark, held[:1], held, names)[1], 4, sample_rows=50, iterations=2)
    assert made.shape[1] == 16 and 1 <= len(made) <= 4 and np.allclose(np.linalg.norm(made, axis=1), 1)
    with pytest.raises(ValueError):
        inverted_file.train_centroids(spark.createDataFrame([("a", [0.0])], "no string, vector array<float>"), 4)
