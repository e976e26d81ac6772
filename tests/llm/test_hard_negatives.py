"""Hilbert order, zone bounds, and mined negatives against brute force."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.llm import hard_negatives


@pytest.mark.parametrize("dims, bits", [(2, 1), (2, 4), (3, 3), (5, 2)])
def test_the_curve_steps_to_a_neighbour(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    places = hard_negatives.curve_places(cells.T, bits)
    assert len(set(places)) == len(cells)
    along = cells[sorted(range(len(cells)), key=lambda i: places[i])]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    block = rng.integers(-300, 300, (200, 7))
    anchors = rng.integers(-300, 300, (50, 7))
    low, high = hard_negatives.score_bounds(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
    scores = anchors @ block.T
    assert (low <= scores).all() and (scores <= high).all()
    point = hard_negatives.score_bounds(anchors, block, block)
    assert (point[0] == scores).all() and (point[1] == scores).all()


def plain(rows, anchors, positives=5, negatives=10):
    held = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in vector])
        held[key] = min(held.get(key, row), row)
    out = []
    for a in sorted(set(anchors) & set(held)):
        label, v = held[a]
        scored = [(-sum(x * y for x, y in zip(v, w)), k, other) for k, (other, w) in held.items() if k != a and len(w) == len(v)]
        near = sorted(s for s in scored if s[2] == label)[:positives]
        for p, positive, _ in near:
            fit = sorted((s, k) for s, k, other in scored if other != label and -30 * p <= -100 * s <= -90 * p)
            out += [(a, positive, i + 1, k, -p, -s) for i, (s, k) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    made = []
    for i in range(240):
        centre = rng.randrange(4)
        made.append((i, [rng.gauss(1.0 if d % 4 == centre else 0.0, 0.4) for d in range(8)], rng.randrange(3)))
    made += [(1000 + i, [0.5] * 8, i % 2) for i in range(150)]  # one vector with a third of all rows, ties
    made += [(300, None, 1), (301, [0.1] * 7 + [None], 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] + [0.0] * 7, 0),
             (304, [0.2] * 8, None), (None, [0.3] * 8, 1), (305, [], 1), (306, [], 2), (307, [], 1), (308, [0.4, 0.5], 1),
             (309, [0.4, 0.6], 1), (310, [0.4, 0.4], 0), (311, [-1.0] * 8, 5), (312, [0.0] * 8, 6), (313, [0.0] * 8, 6),
             (7, [0.9] * 8, 0), (7, [0.9] * 8, 0), (20, [0.9] * 8, 9)]
    return made


@pytest.fixture(scope="module")
def vectors(spark, rows):
    # columns whose names the operator uses inside
    return spark.createDataFrame([(*r, 1, "x") for r in rows],
                                 "vec_id long, embedding array<float>, label int, block int, key string").repartition(3)


@pytest.mark.parametrize("sizes", [dict(), dict(block_rows=10, range_rows=60, group_anchors=7, sheet_zones=5)])
def test_against_brute_force(spark, vectors, rows, sizes):
    anchors = [r[0] for r in rows if r[0] is not None and (r[0] % 10 == 0 or r[0] in (7, 305, 308, 311, 312))] + [9999]
    asked = spark.createDataFrame([(a,) for a in anchors * 2], "vec_id long")
    found = hard_negatives.mine(vectors, asked, **sizes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, anchors)


def test_blocks_are_pure_bounded_and_whole(vectors):
    rows = hard_negatives.usable(vectors, "vec_id", "label", "embedding")
    blocks = hard_negatives.write_blocks(rows, 16, 100).collect()
    labels = {r["key"]: r["label"] for r in rows.collect()}
    seen = []
    for b in blocks:
        keys = np.frombuffer(b["keys"], "<i8").tolist()
        assert len(keys) == b["n"] <= 16 and {labels[k] for k in keys} == {b["label"]}
        m = np.frombuffer(b["vectors"], "<i8").reshape(b["n"], b["dims"])
        assert m.min(axis=0).tolist() == b["low"] and m.max(axis=0).tolist() == b["high"]
        seen += keys
    assert sorted(seen) == sorted(labels) and len({b["block"] for b in blocks}) == len(blocks)


def test_zones_leave_out_most_blocks_of_clustered_vectors(spark):
    """Work that the bounds save: 32 far-apart clusters, each anchor reads few blocks, with the same result."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 2, (32, 8))
    rows = [(i, (centres[i % 32] + rng.normal(0, 0.05, 8)).tolist(), int(i % 32 // 8)) for i in range(3200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    held = hard_negatives.usable(vectors, "vec_id", "label", "embedding")
    blocks = hard_negatives.write_blocks(held, 32, 800)
    asked = held.where("key % 100 = 0").withColumn("least", F.array(F.lit(hard_negatives.LOW))).withColumn(
        "most", F.array(F.lit(hard_negatives.HIGH)))
    best = hard_negatives.search_windows(asked, blocks, 3, True)
    ends = best.where("rank = 3").select("anchor", F.array("score").alias("least"))
    narrow = asked.withColumn("last", F.array(F.lit(hard_negatives.HIGH))).drop("least").join(ends, F.col("key") == F.col("anchor")).drop("anchor")
    chosen = hard_negatives._blocks_to_read(hard_negatives._groups(narrow, 100), blocks, True, False, 100)
    read = chosen.select(F.sum(F.octet_length("anchors") / 4)).first()[0]
    assert read < 0.35 * 32 * blocks.where("label = 0").count()  # of the anchor's own label


def test_empty_tables(spark, vectors):
    assert hard_negatives.mine(vectors.where("false"), vectors).collect() == []
    assert hard_negatives.mine(vectors, vectors.where("false")).collect() == []
