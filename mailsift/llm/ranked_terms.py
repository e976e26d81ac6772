"""Ranked search of all documents for many queries: accumulator-limited term-at-a-time, with exact results.

Terms are the runs of ASCII letters and digits and of signs beyond ASCII, A-Z lower-cased.  The score of a document is the
sum over the query's terms of w * ((1000000000 * tf) div (1000 * tf + 12 * m)), all in 64-bit whole numbers (see `search`).

1. One pass over the texts writes blocks of postings of the queries' terms: per block of documents, each term's documents
   with their tf.  Document frequencies, N and L are sums of per-block counts.
2. Each task searches its blocks, one query after the other.  The query's terms are processed rarest first, each with an
   upper bound (its largest contribution in the block).  A document gets an accumulator at the first term it holds, while the
   sum of the bounds of this and all later terms can still reach the k-th score: the k-th best partial score of the block or,
   if larger, the k-th best full score this task has seen.  After that no accumulators are created; the survivors go on to be
   updated, and those that the remaining bounds cannot lift to the k-th score are left out.
3. Each task sends its k best documents of each query, and the k best of these are the result.

A document without an accumulator, or one left out, scores less than k others, so results are those of the full sum.

Query terms are dealt into scans of at most `scan_terms` terms, whole queries together, so that what each scan broadcasts is
bounded; every scan reads the texts once.  Blocks hold whole documents and are cut by the number of their terms.

Defined results: null texts have no terms; documents without terms count in neither N nor L; documents with a null key take
no part; rows with equal document keys are documents of their own; rows of one query key are one query with all their terms;
queries with a null key, without terms or without a matching document give no rows; an empty table gives none.  Terms are
compared by 64 bits of hash and by their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import top_k
from ..storage import materialise
from .words import lower_ascii, running, slices, span_hashes

TOP = 20
SCAN_TERMS = 200_000
#: Terms of the documents in one block of postings, about.
BLOCK_TERMS = 2_000_000

#: Whether a byte of UTF-8 text belongs to a term.
IN_TERM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


class Terms:
    """The terms of a list of texts: their hashes, the places of their bytes and the bounds of each text's terms."""

    def __init__(self, texts: list):
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = lower_ascii(np.frombuffer(b" ".join(encoded), np.uint8))
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = IN_TERM[self.data]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.hashes = span_hashes(running(self.data), self.starts, self.ends)
        limits = np.cumsum([len(e) + 1 for e in encoded])
        self.counts = np.diff(np.searchsorted(self.starts, limits), prepend=0)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, term, hash, times): the terms of every query and how often it holds them."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = frame["key"].to_numpy()
            for a, b in slices(frame["text"].tolist()):
                found = Terms(frame["text"].tolist()[a:b])
                yield pd.DataFrame({"query": np.repeat(keys[a:b], found.counts), "hash": found.hashes.view(np.int64),
                                    "term": [found.word(i) for i in range(len(found.hashes))]})

    rows = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    words = rows.mapInPandas(cut, "query long, hash long, term binary")
    return words.groupBy("query", "term", "hash").agg(F.count("*").alias("times"))


def _scans(terms: DataFrame, scan_terms: int) -> list[DataFrame]:
    """The queries' terms in parts of about `scan_terms` rows, whole queries together."""
    n = terms.count()
    parts = -(-n // scan_terms)
    return [terms if parts == 1 else terms.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == i) for i in range(parts)]


# --- postings ------------------------------------------------------------------------------------------------

def postings(docs: DataFrame, words: list[tuple[int, bytes]], key: str, text: str, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Blocks of postings of the given (hash, term) pairs, which are in order of hashes; terms are known by their place in it.

    (keys, lengths, terms, begins, docs, tfs, n_docs, n_terms), all but the last two as packed arrays: `docs` and `tfs` hold
    the documents (by place in the block) and frequencies of term `terms[i]` from `begins[i]` on.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(words)

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = np.array([h for h, _ in sent.value], np.int64).view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        names = [t for _, t in sent.value]
        keys, lengths, hits, n, n_docs = [], [], [], 0, 0

        def close() -> pd.DataFrame:
            doc, term, tf = (np.concatenate([h[i] for h in hits]) for i in range(3))
            by = np.argsort(term.astype(np.int64) * n_docs + doc)
            doc, term, tf = doc[by], term[by], tf[by]
            first = np.flatnonzero(np.diff(term, prepend=-1))
            return pd.DataFrame([(
                np.concatenate(keys).astype("<i8").tobytes(), np.concatenate(lengths).astype("<i8").tobytes(),
                term[first].astype("<i4").tobytes(), np.append(first, len(term)).astype("<i8").tobytes(),
                doc.astype("<i4").tobytes(), tf.astype("<i4").tobytes(), n_docs, n)],
                columns=["keys", "lengths", "terms", "begins", "docs", "tfs", "n_docs", "n_terms"])

        for frame in frames:
            all_keys, texts = frame["key"].to_numpy(), frame["text"].tolist()
            for a, b in slices(texts):
                found = Terms(texts[a:b])
                at = np.searchsorted(hashes, found.hashes)
                at[at == len(hashes)] = 0
                known = np.flatnonzero(hashes[at] == found.hashes) if len(hashes) else at[:0]
                term = order[at[known]] if len(known) else known
                # The bytes too must be those of the term: looked at once per distinct term of the slice.
                one, where = np.unique(term, return_index=True)
                false = [t for t, i in zip(one.tolist(), known[where].tolist()) if found.word(i) != names[t]]
                if false:
                    known = known[~np.isin(term, false)]
                    term = order[at[known]]
                doc = np.repeat(np.arange(b - a), found.counts)[known] + n_docs
                pair, tf = np.unique(doc * max(len(names), 1) + term, return_counts=True)
                hits.append(tuple(x.astype(np.int32) for x in (*np.divmod(pair, max(len(names), 1)), tf)))
                keys.append(all_keys[a:b])
                lengths.append(found.counts)
                n += int(found.counts.sum())
                n_docs += b - a
                if n >= block_terms:
                    yield close()
                    keys, lengths, hits, n, n_docs = [], [], [], 0, 0
        if n_docs:
            yield close()

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(blocks, "keys binary, lengths binary, terms binary, begins binary, docs binary, tfs binary, "
                                    "n_docs long, n_terms long")


def statistics(blocks: DataFrame) -> tuple[int, int, DataFrame]:
    """N, L and (place, df) of the terms, from the blocks' counts; the postings themselves are not moved."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for terms, begins in zip(frame["terms"], frame["begins"]):
                yield pd.DataFrame({"place": np.frombuffer(terms, "<i4"), "df": np.diff(np.frombuffer(begins, "<i8"))})

    def filled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"n": [int((np.frombuffer(x, "<i8") > 0).sum()) for x in frame["lengths"]],
                                "l": frame["n_terms"]})

    sums = blocks.select("lengths", "n_terms").mapInPandas(filled, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    df = blocks.select("terms", "begins").mapInPandas(count, "place int, df long").groupBy("place").agg(F.sum("df").alias("df"))
    return sums[0] or 0, sums[1] or 0, df


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


# --- term at a time ------------------------------------------------------------------------------------------

def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 12 * m) with m = 100 - 25 + ((25 * length * N) div L)."""
    m = 75 + (25 * length * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def best_documents(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The documents that may be among the k best, with their full scores, and the number of accumulators created.

    `lists` has (documents, contributions) of each term, rarest first; `least` is a k-th best full score known from elsewhere
    (0 if none): documents below it may be left out.
    """
    bounds = [int(c.max()) if len(c) else 0 for _, c in lists]
    rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what this and all later terms can add
    sums = np.zeros(n_docs, np.int64)
    held = np.empty(0, np.int64)
    create, kth = True, least
    for i, (docs, adds) in enumerate(lists):
        if create and rest[i] < kth:  # a new document could no longer reach the k-th score
            create = False
            held = np.flatnonzero(sums)
        if create:
            sums[docs] += adds
            scores = sums
        else:
            # Survivors only: those that the terms still to come can lift to the k-th score.
            held = held[sums[held] + rest[i] >= kth]
            mine = np.zeros(n_docs, bool)
            mine[held] = True
            at = mine[docs]
            sums[docs[at]] += adds[at]
            scores = sums[held]
        if len(scores) > k:
            kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        elif len(scores) == k:
            kth = max(kth, int(scores.min()))
    created = int(np.count_nonzero(sums))
    if create:
        held = np.flatnonzero(sums)
    held = held[(sums[held] >= kth) & (sums[held] > 0)]
    return held, sums[held], created


def _search(blocks: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], n: int, total: int, k: int) -> DataFrame:
    """(query, doc, score, created): each task's k best documents per query, from `queries` of (key, [(place, weight * times)])."""
    sent = blocks.sparkSession.sparkContext.broadcast(queries)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {key: (np.empty(0, np.int64), np.empty(0, np.int64)) for key, _ in sent.value}
        work = dict.fromkeys(best, 0)
        for frame in frames:
            for row in frame.itertuples(index=False):
                keys, lengths = np.frombuffer(row.keys, "<i8"), np.frombuffer(row.lengths, "<i8")
                docs, tfs = np.frombuffer(row.docs, "<i4"), np.frombuffer(row.tfs, "<i4").astype(np.int64)
                begins = np.frombuffer(row.begins, "<i8")
                place = {t: i for i, t in enumerate(np.frombuffer(row.terms, "<i4").tolist())}
                value = impacts(tfs, lengths[docs], n, total) if total else tfs
                for key, terms in sent.value:
                    lists = []
                    for t, w in terms:
                        if t in place and w:
                            a, b = begins[place[t]], begins[place[t] + 1]
                            lists.append((docs[a:b], value[a:b] * w))
                    if not lists:
                        continue
                    had, scores = best[key]
                    found, sums, created = best_documents(lists, len(keys), k, int(scores[-1]) if len(scores) == k else 0)
                    work[key] += created
                    ids, scores = np.concatenate([had, keys[found]]), np.concatenate([scores, sums])
                    first = np.lexsort((ids, -scores))[:k]
                    best[key] = ids[first], scores[first]
        for key, (ids, scores) in best.items():
            if len(ids):
                yield pd.DataFrame({"query": key, "doc": ids, "score": scores, "created": work[key]})

    return blocks.mapInPandas(search, "query long, doc long, score long, created long")


def search(
    docs: DataFrame, queries: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text",
    query_key: str = "item_id", query_text: str = "text", scan_terms: int = SCAN_TERMS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(query_key, rank, key, score): the k best documents of each query with a score above 0, ties by ascending key.

    N counts the documents with at least one term, L all their terms, n one document's terms, df the documents that hold a
    term.  A term weighs floor(1000 * ln((2 * N + 2) / (2 * df + 1))); m = 100 - 25 + ((25 * n * N) div L).
    """
    terms = materialise(query_terms(queries, query_key, query_text), "query-terms")
    found = [_scan(docs, part, k, key, text, block_terms) for part in _scans(terms, scan_terms)]
    empty = docs.sparkSession.createDataFrame([], "query long, doc long, score long, created long")
    for part in found:
        empty = empty.unionByName(part)
    ranked = top_k(empty, ["query"], [F.col("score").desc(), F.col("doc")], k, rank="rank")
    return ranked.select(F.col("query").alias(query_key), F.col("rank").cast("int").alias("rank"),
                         F.col("doc").alias(key), "score")


def _scan(docs: DataFrame, terms: DataFrame, k: int, key: str, text: str, block_terms: int) -> DataFrame:
    """One reading of the texts for the queries of one part; the part's terms, a bounded number, travel to the tasks."""
    rows = terms.collect()
    words = sorted({(r["hash"], bytes(r["term"])) for r in rows})
    blocks = materialise(postings(docs, words, key, text, block_terms), "postings")
    n, total, df = statistics(blocks)
    frequency = {r["place"]: r["df"] for r in df.collect()}  # no more rows than the part has terms
    place = {w: i for i, w in enumerate(words)}
    asked: dict[int, list[tuple[int, int, int]]] = {}
    for r in rows:
        at = place[(r["hash"], bytes(r["term"]))]
        if at in frequency:
            asked.setdefault(r["query"], []).append((frequency[at], at, weight(n, frequency[at]) * r["times"]))
    return _search(blocks, [(q, [(t, w) for _, t, w in sorted(ts)]) for q, ts in sorted(asked.items())], n, total, k)
