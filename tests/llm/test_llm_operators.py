"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from mailsift.llm import (components, decontaminate, fuzzy_lines, html_text, near_dedup, packing, pseudonyms, queries,
                          substrings, topk, toxicity, url_rules, words)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def edge_texts():
    """Texts with copies, near copies, shared passages, blanks of all kinds, one very long text, nulls and empties."""
    rng = random.Random(5)
    base = sentence(rng, 120, 5000)
    shared = sentence(rng, 20, 5000)
    texts = [None, "", "  \n\t ", "one", "One", base, base, base.replace("w", "W", 3)]
    for _ in range(12):
        cut = base.split()
        cut[rng.randrange(len(cut))] = "changed"
        texts.append(" ".join(cut))
    texts += [sentence(rng, 60, 5000) + "\n" + shared + "\r\n" + sentence(rng, 30, 5000) for _ in range(6)]
    texts += [sentence(rng, 3), "é ü " + shared, sentence(rng, 6000, 9000), "x" * 20000, "a b c d " * 50]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "de" if i % 2 else None, i) for i, t in enumerate(edge_texts())]
    # columns whose names the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, block string, tokens string, n_chars long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def as_rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_word_hashes_follow_words():
    rng = random.Random(1)
    texts = edge_texts() + [sentence(rng, 10)]
    found = words.Texts(texts)
    names = {}
    at = 0
    for t in texts:
        for w in WORD.findall(t or ""):
            assert names.setdefault(w, found.hashes[at]) == found.hashes[at]
            at += 1
    assert at == len(found.hashes) and len(set(names.values())) == len(names)


# --- URL rules -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://A.Example.ORG/es/1?x=/en", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("https://x.com/DE/", "x.com", "/DE/", None, "allow"),
    ("https://notexample.org", "notexample.org", "", None, "allow"),
    ("https://x.com?u=http://y.org/", "x.com", "", None, "allow"),
    ("mailto:x@y.org", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
])
def test_given_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x"), (1, url, "y")], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "items array<string>, confidence double, support double, rule_id long")
    rows = as_rows(url_rules.judge(pages, queries.URL_RULES, none))
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [(host, path, rule, verdict)] * 2


def test_mined_url_rules(spark):
    labelled = [(f"http://bad.example.net/en/{i}", True) for i in range(60)]
    labelled += [(f"http://good.example.net/{'en' if i % 2 else 'fr'}/{i}", False) for i in range(200)] + [(None, None)]
    mined = url_rules.mine(spark.createDataFrame(labelled, "url string, blocked boolean"))
    rules = {tuple(r["items"]) for r in as_rows(mined)}
    assert ("host=bad.example.net",) in rules
    assert all(len(r) == 1 for r in rules if "host=bad.example.net" in r)  # longer ones are no surer
    pages = spark.createDataFrame([(1, "http://bad.example.net/es/1"), (2, "http://good.example.net/en/7"), (None, None)],
                                  "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in as_rows(url_rules.judge(pages, (), mined))}
    assert got == {1: "block", 2: "allow", None: "allow"}


def test_rules_need_no_fixed_number_of_rows(spark):
    """Few rows are enough where they are sure, and many are not where chance would do as well."""
    few = [(f"http://bad.example.net/x/{i}", True) for i in range(14)]
    few += [(f"http://ok.example.org/{i}", False) for i in range(14)]
    mined = url_rules.mine(spark.createDataFrame(few, "url string, blocked boolean"))
    assert ("host=bad.example.net",) in {tuple(r["items"]) for r in as_rows(mined)}
    rng = random.Random(3)
    noise = [(f"http://h{'abcdefghij'[rng.randrange(10)]}.example.net/p{'klmnopqrst'[rng.randrange(10)]}/{i}", rng.random() < 0.5)
             for i in range(400)]
    assert url_rules.mine(spark.createDataFrame(noise, "url string, blocked boolean")).count() == 0
    for same in (True, False):  # nothing to tell apart
        assert url_rules.mine(spark.createDataFrame([(u, same) for u, _ in few], "url string, blocked boolean")).count() == 0


def test_parts_of_a_rule(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],)], "items array<string>")
    got = [sorted(map(tuple, r[0])) for r in df.select(url_rules._parts(F.col("items"))).collect()]
    assert got == [[("a",)], [("a",), ("b",)], [("a",), ("a", "b"), ("a", "c"), ("b",), ("b", "c"), ("c",)]]


def test_no_labels_mine_no_rules(spark):
    assert url_rules.mine(spark.createDataFrame([], "url string, blocked boolean")).count() == 0


# --- substring dedup -----------------------------------------------------------------------------------------------

def test_substrings_against_brute_force(docs):
    first, texts = {}, edge_texts()
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    for r in as_rows(substrings.remove_repeats(docs)):
        w = WORD.findall(texts[r["doc_id"]] or "")
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < r["doc_id"]:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(gone), kept)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_substrings_keys(spark, empty):
    assert substrings.remove_repeats(empty).count() == 0
    text = sentence(random.Random(2), 30)
    rows = [(None, text), (4, text), (4, text), (9, text)]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in as_rows(
        substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == [("4", 0), ("4", 0), ("9", 30), ("None", 0)]


# --- pseudonyms ----------------------------------------------------------------------------------------------------

PRIVATE = ["a 4111111111111111 b", "4111 1111 1111 1111.", "Jo.Doe_7@x.example.com!", "+1 (456) 555-2186",
           "ip 233.254.104.120", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "born 1984-02-29, 29/02/1984",
           "ssn 078-05-1120", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
PUBLIC = [None, "", "plain", "4111111111111112", "1.2.3.999", "1984-02-30", "000-12-1234", "v2.0 CC BY-NC 4.0."]


def test_pseudonyms_keep_form_and_come_back(spark):
    df = spark.createDataFrame(list(enumerate(PRIVATE + PUBLIC)), "doc_id long, text string").withColumn("private", F.lit(1)).drop("private")
    hidden = pseudonyms.pseudonymise(df, "key").cache()
    shown = {r["doc_id"]: r["text"] for r in as_rows(pseudonyms.pseudonymise(hidden.select("doc_id", "text"), "key", reveal=True))}
    for r in as_rows(hidden):
        before = (PRIVATE + PUBLIC)[r["doc_id"]]
        if r["doc_id"] >= len(PRIVATE):
            assert r["text"] == before and r["n_private"] == 0
        else:
            assert r["text"] != before and r["n_private"] >= 1 and shown[r["doc_id"]] == before
            form = [re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x))) for x in (before, r["text"])]
            assert "token" in before or "ip" in before or form[0] == form[1]


def test_private_values_beside_other_numbers_are_hidden(spark):
    card, iban = "4111111111111111", "GB82 WEST 1234 5698 7654 32"
    texts = [f"{card} 12/27", "4111 1111 1111 1111 123", "room 12 4111 1111 1111 1111", "1234 4111 1111 1111 1111 99 7",
             f"{card} 5500-0000-0000-0004 378282246310005", "4111 1111 1111 1111 2024-01-02", f"{card} 078-05-1120",
             f"{iban} FROM JOHN", f"{iban} 4111 1111 1111 1111", "on 12/25/1990 and 25/12/1990", "1 " * 20000 + card]
    texts += [f"{n:04d} 4111 1111 1111 1111" for n in range(40)] + [f"{m:02d}/{d}/1990" for m in (1, 6, 12) for d in (13, 20, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hidden = pseudonyms.pseudonymise(df, "key").cache()
    shown = {r["doc_id"]: r["text"] for r in as_rows(pseudonyms.pseudonymise(hidden.select("doc_id", "text"), "key", reveal=True))}
    for r in as_rows(hidden):
        before = texts[r["doc_id"]]
        assert shown[r["doc_id"]] == before and r["n_private"] >= 1
        for secret in (card, "4111 1111 1111 1111", "5500-0000", "378282246310005", "2024-01-02", "078-05-1120", "WEST", "/1990"):
            assert secret not in r["text"]
        assert ("JOHN" in before) == ("FROM JOHN" in r["text"])
    counts = {r["doc_id"]: r["n_private"] for r in as_rows(hidden)}
    assert [counts[i] for i in (4, 5, 6, 8, 9)] == [3, 2, 2, 2, 2]


def test_equal_values_stay_linked(spark):
    rows = [(1, "4111111111111111"), (2, "x 4111-1111-1111-1111 y")]
    got = [re.sub("[^0-9]", "", r["text"]) for r in as_rows(
        pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key"))]
    assert got[0] == got[1] != "4111111111111111"
    digits = [int(c) for c in got[0]][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_feistel_is_a_bijection(spark):
    df = spark.range(0, 900).select(pseudonyms.permute(
        F.array((F.col("id") / 100).cast("int"), (F.col("id") / 10 % 10).cast("int"), (F.col("id") % 10).cast("int")),
        F.array(F.lit(9), F.lit(10), F.lit(10)), "key", F.lit("test")).alias("v"))
    assert len({tuple(r["v"]) for r in df.collect()}) == 900


# --- near dedup and lines ------------------------------------------------------------------------------------------

def union(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(30)] + [(rng.randrange(40, 90), rng.randrange(40, 90)) for _ in range(30)]
    roots = union(90, links)
    got = {r["node"]: r["root"] for r in as_rows(components.components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {x: roots[x] for link in links for x in link if link[0] != link[1]} | {
        x: got[x] for x in got if roots[x] == got[x]}
    empty = spark.createDataFrame([], "a long, b long")
    assert components.components(empty).count() == 0
    # links found later, on top of known components: a chain, a star around the largest node, repeats and loops
    early = links[:20] + [(99, x) for x in range(60, 80)]
    late = links[20:] + [(7, 7), (99, 60), (99, 60)]
    roots = union(100, early + late)
    known = components.components(spark.createDataFrame(early, "a long, b long"))
    got = as_rows(components.components(spark.createDataFrame(late, "a long, b long"), known))
    nodes = {x for a, b in early + late for x in (a, b) if a != b}
    assert len(got) == len(nodes) and {r["node"]: r["root"] for r in got} == {x: roots[x] for x in nodes}
    unchanged = as_rows(components.components(empty, known))
    early_roots = union(100, early)
    assert sorted((r["node"], r["root"]) for r in unchanged) == sorted(
        (x, early_roots[x]) for x in {x for a, b in early for x in (a, b) if a != b})


def test_near_duplicates_against_brute_force(docs, empty):
    sets = []
    for t in edge_texts():
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = union(len(sets), links)
    rows = as_rows(near_dedup.near_duplicates(docs))
    assert len(rows) == len(sets)
    for r in rows:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), roots[i], roots[i] == i)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_pairs_whose_leaders_are_unlike_both_are_found(spark):
    import numpy as np

    rng = random.Random(14)
    base = sentence(rng, 60, 100000)
    # the leader of the only shared bucket, 0, is unlike the two documents that are alike
    rows = [(0, "stranger one " + sentence(rng, 60, 100000)), (1, base), (2, base + " end"), (3, sentence(rng, 50, 100000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dedup.shingle_sets([t for _, t in rows], 4)
    sketch = near_dedup.odd_sketches(near_dedup.min_hashes(sets, 128))
    members = spark.createDataFrame(
        [(7, k, 0) for k, _ in rows], "bucket long, node long, leader long")
    edges = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "node long, root long")
    strays = near_dedup._strays(members, edges, roots).join(spark.createDataFrame(
        [(k, bytearray(s.tobytes()), h.view(np.int64).tolist()) for (k, _), s, h in zip(rows, sets, sketch)],
        "node long, set binary, sketch array<long>"), "node")
    for block in (1, 2, 512):
        links = {(r["a"], r["b"]) for r in as_rows(near_dedup.stray_links(strays, 80, block))}
        assert links == {(2, 1)}
    got = {r["doc_id"]: r["component_id"] for r in as_rows(near_dedup.near_duplicates(docs))}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3}


def test_lines_against_brute_force(spark, empty):
    rng = random.Random(8)
    base = [sentence(rng, 30, 5000) for _ in range(6)]
    texts = [None, "", "\n\n", "short", "short\nother", *["\n".join([base[i % 6], sentence(rng, 12, 5000), base[(i + 1) % 6] + " end"])
                                                         for i in range(12)]]
    docs = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts)], "doc_id long, text string, extra long")
    lines = []
    for i, t in enumerate(texts):
        lines += [(i, p, x) for p, x in enumerate((t or "").split("\n")) if x.strip()]
    sets = [{x[k:k + 8] for k in range(len(x) - 7)} or {x} for _, _, x in lines]
    roots = union(len(lines), [(a, b) for a in range(len(lines)) for b in range(a)
                               if lines[a][2] == lines[b][2] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    gone = {lines[i][:2] for i in range(len(lines)) if roots[i] != i}
    for r in as_rows(fuzzy_lines.dedup_lines(docs)):
        t = texts[r["doc_id"]]
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (r["doc_id"], p) not in gone)
        assert (r["text"], r["extra"]) == (kept, r["doc_id"] * 2)
    assert fuzzy_lines.dedup_lines(empty).count() == 0


def line_links(lines, size=fuzzy_lines.SIZE):
    """The pairs of lines that are alike, by their sets of code points."""
    sets = [{x[k:k + size] for k in range(len(x) - size + 1)} or {x} for x in lines]
    return [(a, b) for a in range(len(lines)) for b in range(a)
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def test_line_sets_are_of_code_points():
    rng = random.Random(3)
    alphabet = "abcdef é한국어\U0001f600"
    lines = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    lines += [x[:-1] + "z" for x in lines[::3]] + lines[:20] + ["a" * 70000, "b" * 300]
    sets = [{x[k:k + 5] for k in range(len(x) - 4)} or {x} for x in lines]
    packed = [x.encode() for x in lines]
    assert [len(s) for s in fuzzy_lines.line_sets(packed, 5)] == [len(s) for s in sets]
    assert fuzzy_lines.set_sizes(packed, 5).tolist() == [len(s) for s in sets]
    other = packed[::-1]
    assert fuzzy_lines.percents(packed, other, 5).tolist() == [
        100 * len(a & b) // len(a | b) for a, b in zip(sets, sets[::-1])]


def test_alike_lines_are_found_at_every_length(spark):
    rng = random.Random(12)
    lines = []
    for low, high, letters in ((10, 30, "abcdefghij "), (30, 50, "abcdefghij "), (50, 80, "abcdefghij "),
                               (80, 200, "abcdefghij "), (60, 80, "가나다라마바사아자차 ")):
        for _ in range(60):
            x = "".join(rng.choice(letters) for _ in range(rng.randrange(low, high))).strip() + "."
            at = rng.choice((0, len(x) - 1, rng.randrange(len(x))))
            lines += [x, x[:at] + "q" + x[at + 1:]]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    links = line_links(lines)
    assert len(links) > 100
    roots = union(len(lines), links)
    found = {r["doc_id"] for r in as_rows(fuzzy_lines.dedup_lines(docs)) if r["n_removed"]}
    assert found <= {i for i in range(len(lines)) if roots[i] != i}
    for low, high in ((0, 50), (50, 80), (80, 300)):
        gone = {i for i in range(len(lines)) if roots[i] != i and low <= len(lines[i]) < high}
        assert len(found & gone) >= 0.95 * len(gone) > 0


def test_lines_whose_leaders_are_unlike_both_are_found(spark):
    """All lines share a long passage, so buckets are crowded, and pairs differ in one letter of their own part."""
    rng = random.Random(14)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(60)).strip()
    lines = []
    for _ in range(150):
        own = "".join(rng.choice("abcdefghijklmnop ") for _ in range(120)).strip()
        lines += [passage + own, passage + own[:-1] + "Z"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    roots = union(len(lines), line_links(lines))
    found = {r["doc_id"] for r in as_rows(fuzzy_lines.dedup_lines(docs)) if r["n_removed"]}
    assert found == {i for i in range(len(lines)) if roots[i] != i} and len(found) >= 150


def test_strays_of_small_and_large_buckets_meet(spark):
    x = "the same long line of text with a number 1 in it and some more words"
    lines = [x, x.replace("1", "2"), "something else that is not like the other two lines at all", "a fourth line, unlike"]
    rows = [(7, i, len(t) - 4, i, i != 3) for i, t in enumerate(lines)]
    strays = spark.createDataFrame(rows, "bucket long, node long, n_shingles long, root long, stray boolean").selectExpr(
        "*", "3L as strays", "4L as n")
    sets = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(lines)], "node long, `set` binary")
    many = strays.withColumn("n", F.col("n") + fuzzy_lines.SMALL_BUCKET)
    for members in (strays, many):
        links = fuzzy_lines._links_of_strays(members, sets, 5, 80, 512)
        assert {(r["a"], r["b"]) for r in as_rows(links)} == {(1, 0)}


def test_lines_leave_other_columns_alone(spark):
    line = "a line that stands in all of the texts"
    docs = spark.sql(f"""SELECT id AS doc_id, CASE WHEN id = 3 THEN NULL ELSE '{line}\\nown ' || id END AS text,
        TIMESTAMP '2020-01-01 01:02:03.123456' AS at, 7 AS n_lines, 'x' AS input_n_lines, map(id, double('NaN')) AS m,
        CAST(1.10 AS DECIMAL(9, 2)) AS price, X'00ff' AS raw, CAST(NULL AS STRING) AS none, 'k' AS _key,
        named_struct('a', array(id, NULL)) AS deep FROM range(5)""")
    got = fuzzy_lines.dedup_lines(docs).orderBy("doc_id")
    assert got.columns == ["doc_id", "text", "at", "input_input_n_lines", "input_n_lines", "m", "price", "raw", "none", "_key",
                           "deep", "n_lines", "n_removed"]
    for r, d in zip(got.collect(), docs.orderBy("doc_id").collect()):
        assert (r["at"], r["input_input_n_lines"], r["price"], r["raw"], r["none"], r["deep"]) == (
            d["at"], 7, d["price"], d["raw"], None, d["deep"]) and str(r["m"]) == str(d["m"])
        assert r["n_lines"] == (0 if r["doc_id"] == 3 else 2)
        assert r["text"] == {0: line + "\nown 0", 3: None}.get(r["doc_id"], f"own {r['doc_id']}")


def test_lines_of_repeated_keys_do_not_depend_on_order(spark):
    rows = [(1, "a line of two texts\nfirst"), (1, "a line of two texts\nsecond"), (1, "a line of two texts\nfirst"),
            (None, "a line of two texts"), (0, "zero")]
    results = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        results.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_removed"])
                              for r in as_rows(fuzzy_lines.dedup_lines(docs))))
    assert results[0] == results[1]
    assert sum(r[3] for r in results[0]) == 3 and (True, 0, "a line of two texts", 0) in results[0]


# --- pages ---------------------------------------------------------------------------------------------------------

def test_marked_pages():
    page = ("<html><head><title>t</title><script>var x='</p>'</script></head><body><nav><ul><li><a>Menu</a></ul></nav>"
            "<div class='cookie-notice'>ok?</div><article><header><h1>Head &amp;amp; 1</h1></header><p><b>First<br>line"
            "<p>Second  &lt;i&gt;\n x</p><form><p>mail</form><aside>side</aside><div id=comments><p>me too</div></article>"
            "<footer>&copy;</footer>")
    assert [t for s, t in html_text.blocks(page) if s == html_text.TEXT] == ["Head &amp; 1", "First line", "Second <i> x"]


@pytest.mark.parametrize("silent, shown", [
    ("<svg class='i'/>", ["a", "b", "c"]), ("<math/>", ["a", "b", "c"]), ("<svg viewBox='0'>", ["a", "b", "c"]),
    ("<iframe src='x'>", ["a", "b", "c"]), ("<script src='x' />", ["a", "b", "c"]), ("<script>var p", ["a"]),
    ("<svg><text>t</text></svg>", ["a", "b", "c"]), ("<object>t</object>", ["a", "b", "c"])])
def test_silent_elements_cut_no_text_after_them(silent, shown):
    page = f"<article><p>a</p>{silent}<p>b</p><p>c</p></article>"
    assert [t for s, t in html_text.blocks(page) if s == html_text.TEXT] == shown
    icon = "<article><p>a</p><svg/><p>b</p><svg><text>t</text></svg><p>c</p></article>"
    assert [t for s, t in html_text.blocks(icon) if s == html_text.TEXT] == ["a", "b", "c"]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.choice("abcd") for _ in range(rng.randrange(9))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(9))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert sum(html_text.shared_lines(a, b)) == table[-1][-1]


def test_unmarked_pages_lose_what_neighbours_share(spark):
    rows = [(i, f"http://h.example/p/{i}", f"<div>Site</div><p>text {i}</p><p>Contact us</p>") for i in range(5)]
    rows += [(9, None, None), (10, "http://h.example/q", "")]
    got = {r["page_id"]: r["text"] for r in as_rows(html_text.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)))}
    assert len(got) == 7 and got[9] == got[10] == ""
    assert sum(got[i] == f"text {i}" for i in range(5)) >= 4  # a page alone in its partition has no neighbour


# --- toxicity ------------------------------------------------------------------------------------------------------

def test_toxicity_finds_marked_words_and_ignores_the_held_out_fold(spark):
    rng = random.Random(6)
    bad = ["idiotx", "scumly", "trashic"]
    texts, labels = [], []
    for i in range(400):
        w = [f"w{rng.randrange(3000)}" for _ in range(40)]
        if i % 5 == 0:
            w[rng.randrange(40)], w[rng.randrange(40)] = rng.choice(bad), rng.choice(bad)
        texts.append((i, " ".join(w)))
        fold = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, int(i % 5 == 0) if not fold else int(i % 5 != 0)))  # labels of the held-out fold are wrong
    texts += [(1000, None), (1001, ""), (None, "scumly")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    rows = as_rows(toxicity.score(docs, model))
    assert len(rows) == 403 and all(0 <= r["score"] <= 1 for r in rows)
    wrong = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 400 and r["predicted"] != (r["doc_id"] % 5 == 0)]
    assert len(wrong) <= 8
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows if r["doc_id"] is not None)
    assert toxicity.accepted(docs, model).count() == sum(r["predicted"] == 0 for r in rows)
    none = toxicity.train(docs, marks.where("doc_id < 0"))
    assert {r["score"] for r in as_rows(toxicity.score(docs, none))} == {0.0}


def test_block_max_search_is_exact():
    import numpy as np

    rng = np.random.default_rng(7)
    vectors = []
    for _ in range(300):
        terms = rng.choice(30, rng.integers(1, 5), replace=False).tolist()
        w = rng.random(len(terms)) + 0.1
        vectors.append(dict(zip(terms, (w / np.sqrt((w * w).sum())).tolist())))
    index = toxicity.BlockMaxIndex(vectors, np.ones(300, int), np.zeros(300, int), block=16)
    for q in vectors[:40]:
        every = sorted((round(sum(w * v.get(t, 0) for t, w in q.items()), 9) for v in vectors), reverse=True)
        least = every[9]
        assert [round(x, 9) for x in index.nearest(q, 10)[1]] == [x for x in every if x >= least and x > 0]


# --- decontamination -----------------------------------------------------------------------------------------------

def test_decontamination(spark, empty):
    rng = random.Random(9)
    item = [f"t{i}" for i in range(25)]
    changed = item[:]
    changed[3], changed[11], changed[19] = "other", "OTHER", "x"
    noise = [sentence(rng, 40, 9000) for _ in range(5)]
    texts = [" ".join([noise[0], *item, noise[1]]), " ".join([noise[2], *changed]).upper(), " ".join([*item[:8], noise[3]]),
             " ".join(item[5:18]), noise[4], None, "", " ".join(item) * 40]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    bench = spark.createDataFrame([(7, " ".join(item), "a"), (8, None, "b"), (9, "", "c"), (None, noise[4], "d")],
                                  "item_id long, text string, seed string")
    got = as_rows(decontaminate.overlaps(docs, bench))
    assert sorted({(r["doc_id"], r["item_id"]) for r in got}) == [(0, 7), (1, 7), (3, 7), (7, 7)]
    assert next(r["doc_start"] - r["item_start"] for r in got if r["doc_id"] == 0) == 40
    assert [r["doc_id"] for r in as_rows(decontaminate.clean(docs, bench).orderBy("doc_id"))] == [2, 4, 5, 6]
    assert decontaminate.overlaps(empty, bench).count() == 0


def test_masks_meet_every_window_with_two_replaced_tokens():
    import itertools

    for bad in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(not any(s + o in bad for o in m) for m in decontaminate.MASKS
                   for s in range(decontaminate.WINDOW - max(m)))


def test_short_masks_meet_every_tolerated_case():
    import itertools
    import math

    for size in range(1, decontaminate.WINDOW):
        masks = decontaminate.short_masks(size)
        for bad in itertools.combinations(range(size), size - math.ceil(0.8 * size - 1e-9)):
            assert any(not set(bad) & set(m) for m in masks)


def test_short_items_against_brute_force(spark):
    import itertools
    import math

    rng = random.Random(12)
    items = {n: [f"q{n}t{i}" for i in range(n)] for n in range(1, 14)}
    texts, want = [], set()
    for n, item in items.items():
        most = n - math.ceil(0.8 * n - 1e-9)
        for k in range(most + 2):
            for bad in itertools.combinations(range(n), k):
                if k <= most:
                    want.add((len(texts), n))
                texts.append(" ".join([sentence(rng, 3), *["other" if i in bad else w for i, w in enumerate(item)], "end"]))
    texts += [" ".join(items[8][:7]), " ".join(items[5]), "end"]  # an item cut off by the end of the text is none
    want.add((len(texts) - 2, 5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    got = as_rows(decontaminate.overlaps(docs, bench))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert all(r["window"] == r["item_id"] and r["doc_start"] in (0, 3) and r["item_start"] == 0 for r in got)


# --- top k ---------------------------------------------------------------------------------------------------------

def test_top_k_against_brute_force(spark):
    import math

    rng = random.Random(10)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, rows[50][1]) for i in range(30)] + [(300, None), (301, [None] * 8), (302, [math.nan] * 8), (303, [math.inf] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in whole:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[r])), r) for r in whole if r != q)[:5]
            want[q] = [(n + 1, r, -s) for n, (s, r) in enumerate(scored)]
    assert dict(got) == want
    assert topk.top_k(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------

def test_packing_round_trip(spark, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    tokenizer = Tokenizer.from_file(path)
    texts = edge_texts() + ["It's we'll 'S don't. <|endoftext|> A<|endoftext|>b ABC,def...g_h#1 2é3 ß—x y ﬁ İ ΑΣ", "é ≠ <|ENDOFTEXT|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = as_rows(packing.pack(docs, path, length=256, group_docs=10, with_ids=True))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"]))
                   for r in own)
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty, path).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(11)
    sizes = sorted((rng.randrange(1, 100) for _ in range(200)), reverse=True)
    room = []
    want = []
    for s in sizes:
        b = next((i for i, r in enumerate(room) if r >= s), len(room))
        if b == len(room):
            room.append(100)
        want.append((b, 100 - room[b]))
        room[b] -= s
    assert list(zip(*packing.first_fit_decreasing(sizes, 100))) == want
