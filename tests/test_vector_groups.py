"""Vectors in groups: what a search sends grows with its queries, not with pairs of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.operators import inverted_file, vectors
from mailsift.storage import new_path

N, K = 800, 4


@pytest.fixture(scope="module")
def held():
    made = np.random.default_rng(4).standard_normal((N, 8)).astype("float32")
    made[700:] = made[:100]
    return made


@pytest.fixture(scope="module")
def tables(spark, held):
    rows = [(i, f"v{i:03d}", f"o{i // 5:03d}", v.tolist()) for i, v in enumerate(held)]
    made = spark.createDataFrame(rows, "query_id long, no string, owner string, vector array<float>").cache()
    made.count()
    return made


def plain(held, allowed=None):
    units = held.astype(float) / np.linalg.norm(held.astype(float), axis=1, keepdims=True)
    scores = np.round(units @ units.T, 9)
    return {(q, f"v{c:03d}") for q in range(N) for c in sorted(range(N), key=lambda c: (-scores[q, c], c))[:K]}


def sent(spark):
    return 2 * spark.sparkContext.defaultParallelism * N * K


def chunks(tables):
    return tables.select(F.col("owner").alias("no"), F.col("no").alias("chunk_id"), F.lit("s").alias("section"),
                         F.lit("t").alias("chunk_text"), "vector")


def test_pairs_are_as_many_as_groups_and_not_as_blocks(spark, tables, held):
    q, v = tables.select("query_id", "vector"), tables.select("no", "vector")
    pairs = vectors.candidate_pairs(q, v, K, block_rows=4, broadcast_queries=0)
    assert pairs.count() <= sent(spark)
    assert {(r.query_id, r.no) for r in vectors.best_pairs(pairs, K).collect()} == plain(held)
    assert vectors.owner_pairs(q, chunks(tables), K, block_rows=4, broadcast_queries=0).count() <= sent(spark)


def test_pairs_of_lists(spark, tables, held):
    q, v = tables.select("query_id", "vector"), tables.select("no", "vector")
    path = new_path(spark, "lists-test")
    inverted_file.write_lists(v, path, lists=4, buckets=2)
    index = inverted_file.read_lists(spark, path)
    assert inverted_file._scored(index, inverted_file._wanted(index, q, 4), K, None, 4).count() <= sent(spark)
    found = inverted_file.nearest_by_lists(q, index, K, probes=1, exact=True, block_rows=16)
    assert {(r.query_id, r.no) for r in found.collect()} == plain(held)


def test_many_groups_of_queries(spark, tables, held, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_VALUES", 8 * 50)
    q, v = tables.select("query_id", "vector"), tables.select("no", "vector")
    found = vectors.best_pairs(vectors.candidate_pairs(q, v, K, block_rows=40, broadcast_queries=0), K)
    assert {(r.query_id, r.no) for r in found.collect()} == plain(held)
    near = vectors.nearest_approximate(q, v, K, 8, tables=30, bits=2)
    assert {(r.query_id, r.no) for r in near.collect()} == plain(held)
    owners = vectors.nearest_by_chunk(q, chunks(tables), K, broadcast_queries=0, block_rows=64)
    whole = vectors.nearest_by_chunk(q, chunks(tables), K)
    columns = ["query_id", "no", "chunk_id", "cosine_score", "position"]
    assert sorted(owners.select(columns).collect()) == sorted(whole.select(columns).collect())
