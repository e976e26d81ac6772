"""Line dedup: copies send no bands on, small clusters are compared together, lines are cut in arrays."""

import itertools
import random

import numpy as np
import pandas as pd

from mailsift.llm import fuzzy_lines, spanning


def test_copies_alone_are_not_sent_on(spark, monkeypatch):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefghij klmnop") for _ in range(120)) for _ in range(40)]
    near = [lines[0][:60] + "Z" + lines[0][61:], lines[1][:-1] + "Z"]
    # each partition is a block: copies meet only where bands do
    docs = spark.createDataFrame([(0, "\n".join(lines)), (1, "\n".join(lines)), (2, "\n".join(near))],
                                 "doc_id long, text string").repartitionByRange(3, "doc_id")
    stored = {}
    plain = fuzzy_lines.materialise
    monkeypatch.setattr(fuzzy_lines, "materialise", lambda df, name: stored.setdefault(name, plain(df, name)))
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert found == {0: ("\n".join(lines), 0), 1: ("", 40), 2: ("", 2)}
    assert stored["lines"].count() == 4


def test_small_clusters_are_compared_together(spark):
    def pieces(rows):
        return pd.DataFrame({"cluster": rows, "place": range(len(rows))})

    whole = pieces([1] * 3 + [2] * 9 + [3] + [4] * 2 + [5] * 4)
    for step, least in itertools.product((1, 2, 5, 50), (1, 4, 100)):
        got = list(spanning.whole_clusters((whole.iloc[k:k + step] for k in range(0, len(whole), step)), least))
        assert pd.concat(got, ignore_index=True).equals(whole)
        assert sum(g["cluster"].nunique() for g in got) == 5
    assert list(spanning.whole_clusters(iter([]), 4)) == []
    one, two = spanning.pairs_of(np.array([7, 7, 7, 8, 9, 9]))
    assert list(zip(one.tolist(), two.tolist())) == [(0, 1), (0, 2), (1, 2), (4, 5)]

    rng = random.Random(5)
    rows, want = [], set()
    for cluster in range(60):
        base = [rng.getrandbits(64) for _ in range(40)]
        n = 12 if cluster % 20 == 0 else 3
        sets = [sorted({*base[:20 + 4 * (k % 5)], *(rng.getrandbits(64) for _ in range(k % 3))}) for k in range(n)]
        for k, values in enumerate(sets):
            rows.append((cluster, 100 * cluster + k, 100 * cluster + k, n, bytearray(np.array(values, np.uint64).tobytes())))
        want |= {(100 * cluster + b, 100 * cluster + a) for a, b in itertools.combinations(range(n), 2)
                 if 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    members = spark.createDataFrame(rows, "cluster long, node long, root long, n long, set binary")
    found = spanning.spanning_links(members, 80, 8)
    assert "MapInPandas" in found._jdf.queryExecution().toString()
    got = {(r["a"], r["b"]) for r in found.collect()}

    def components(links):
        roots = {r[1]: r[1] for r in rows}
        for a, b in links:
            low, high = sorted((roots[a], roots[b]))
            roots = {k: low if v == high else v for k, v in roots.items()}
        return roots

    assert got <= want and components(got) == components(want)


def test_lines_are_cut_in_arrays(spark):
    rows = [(0, "a b\n\nc d\n"), (1, None), (2, ""), (3, "a b"), (4, "\n aé\n\nc d"), (5, " \n\t\nx"), (6, "c d\na b\n"), (7, "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert found == {0: ("a b\n\nc d\n", 2, 0), 1: (None, 0, 0), 2: ("", 0, 0), 3: ("", 1, 1), 4: ("\n aé\n", 2, 1),
                     5: (" \n\t\nx", 1, 0), 6: ("", 2, 2), 7: ("\n", 0, 0)}


def test_texts_that_are_not_utf8_are_cut(spark):
    docs = spark.createDataFrame([(0, bytearray(b"ok line\n\xff\xc3 bad\nok line\xc3")), (1, bytearray(b"\xa9 z\nok line"))],
                                 "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text").coalesce(1)
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert found == {0: ("ok line\n�� bad\nok line�", 0), 1: ("� z", 1)}
