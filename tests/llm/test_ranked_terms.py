"""Term-at-a-time search against the full sum."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from mailsift.llm import ranked_terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    bags = [(key, terms(text)) for key, text in docs if key is not None]
    filled = [b for b in bags if b[1]]
    n, total = len(filled), sum(len(t) for _, t in filled)
    df = {}
    for _, t in filled:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for key, text in items:
        if key is not None:
            asked.setdefault(key, []).extend(terms(text))
    out = []
    for item, words in asked.items():
        rows = []
        for key, t in filled:
            m = 75 + (25 * len(t) * n) // total
            score = 0
            for w in words:
                tf = t.count(w)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (
                        (1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                rows.append((-score, key))
        out += [(item, i + 1, key, -s) for i, (s, key) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def some_texts(rng, n):
    words = ["Alpha", "beta", "γάμμα", "ÄB", "äb", "x1", "1", "the", "THE", "of", "日本", *[f"w{i}" for i in range(60)]]
    weights = [5, 5, 3, 1, 1, 2, 2, 40, 20, 30, 1, *[3 / (i + 1) for i in range(60)]]
    joints = [" ", "\n", "-", ", ", "'", "\x7f", "_"]
    return ["".join(w + rng.choice(joints) for w in rng.choices(words, weights, k=rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    made = some_texts(rng, 300)
    docs = list(enumerate(made)) + [(900, None), (901, ""), (902, " .,; "), (None, "alpha beta"), (903, "w3 " * 3000),
                                    (5, "a second row of key five alpha w7"), (904, "the of"), (905, "the of")]
    docs += [(1000 + i, "copies of the same text w1 alpha") for i in range(150)]  # ties; a third of all rows
    items = list(enumerate(some_texts(rng, 25))) + [(50, None), (51, "..."), (52, "nothing here"), (53, "w3 w3 w3 the"),
                                                    (None, "alpha"), (54, "alpha"), (54, "beta alpha")]
    return docs, items


@pytest.mark.parametrize("k, block_terms, scan_terms", [(20, 2_000_000, 200_000), (3, 500, 200), (1, 90, 40), (400, 5000, 10**6)])
def test_against_the_full_sum(spark, tables, k, block_terms, scan_terms):
    docs, items = tables
    # columns whose names the operator uses inside
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, score int").repartition(3)
    q = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, `query` int")
    found = ranked_terms.search(d, q, k, block_terms=block_terms, scan_terms=scan_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == plain(docs, items, k)


def test_few_accumulators_and_the_same_best_documents():
    rng = np.random.default_rng(3)
    for trial in range(200):
        n, k = int(rng.integers(1, 400)), int(rng.integers(1, 30))
        lists = []
        for size in sorted(rng.integers(1, n + 1, rng.integers(1, 12))):
            docs = np.sort(rng.choice(n, size, replace=False))
            lists.append((docs, rng.integers(1, 50 * n // size + 2, size)))
        full = np.zeros(n, np.int64)
        for docs, adds in lists:
            full[docs] += adds
        best = sorted(full[full > 0].tolist(), reverse=True)[:k]
        least = best[-1] if len(best) == k and trial % 2 else 0
        found, sums, created = ranked_terms.best_documents(lists, n, k, least)
        assert (full[found] == sums).all() and created <= np.count_nonzero(full)
        assert sorted(sums.tolist(), reverse=True)[:k] == best
        assert set(np.flatnonzero((full >= (best[-1] if len(best) == k else 1)) & (full > 0))) <= set(found.tolist())


def test_creation_stops_when_the_rest_cannot_reach_the_best():
    rare, common = np.arange(50), np.arange(10_000)
    lists = [(rare, np.full(50, 1000)), (common, np.full(10_000, 10))]
    found, sums, created = ranked_terms.best_documents(lists, 10_000, 20, 0)
    assert created == 50 and found.tolist() == rare.tolist() and set(sums.tolist()) == {1010}


def test_terms_with_one_hash_are_told_apart(spark, monkeypatch):
    """The bytes decide where hashes are equal."""
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id long, text string")
    alpha = int(ranked_terms.Terms(["alpha"]).hashes.view(np.int64)[0])
    blocks = ranked_terms.postings(docs, [(alpha, b"other")], "doc_id", "text").collect()
    assert all(len(b["docs"]) == 0 for b in blocks) and sum(b["n_docs"] for b in blocks) == 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked_terms.search(docs.where("false"), items).collect() == []
    assert ranked_terms.search(docs, items.where("false")).collect() == []
