"""Toxicity by nearest labelled examples, with exact TF-IDF cosines over a block-max inverted index.

1. A bounded sample of labelled rows gives the examples (`max_examples` per label).
2. Terms are words and word beginnings.  The terms that come with the toxic label far more often than without it are
   kept (`max_terms`); all other words of a text are one constant term, so a text without such terms is near texts
   without them.  Document frequencies of the kept terms are counted over all documents.
3. Examples with equal vectors are one vector with its number of examples per label.  Vectors are ordered so that like
   ones share a block; for each term and block the index knows the largest weight.  For a text, blocks are visited in
   falling order of their bound, until no block can hold a vector among the `k` nearest.  Ties at the k-th cosine all count.
4. The nearest vectors vote with their cosine; votes are weighted for the labels' shares in the whole table and calibrated
   by isotonic regression over leave-one-out votes of the examples.

Labels are read from the training rows only; label, language, source and key are no part of a score.

Defined results: null and empty texts have the constant term only and get its score; rows with a null key are scored and
are never examples; repeated rows get their row each; several labels of one key count as toxic if any is; without
labelled rows of both labels every score is the share of toxic rows (0 without any); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import materialise
from . import words

#: Bytes of word beginnings that are terms; 0 is the whole word.
PREFIXES = (0, 4, 5, 6, 7, 8)
MAX_EXAMPLES = 3000
MAX_TERMS = 2048
MIN_EXAMPLES = 5
MIN_RATIO = 4.0
NEIGHBOURS = 30
REST_WEIGHT = 3.0
BLOCK = 64


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row belongs to the fold that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def term_hashes(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, term hash) of every term of every text, in pieces.  Words are runs of letters and digits."""
    at = 0
    encoded = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace") for t in texts]
    while at < len(encoded):
        size, upto = 0, at
        while upto < len(encoded) and (upto == at or size + len(encoded[upto]) < words.CHUNK):
            size += len(encoded[upto]) + 1
            upto += 1
        data = words.lower_ascii(np.frombuffer(b" ".join(encoded[at:upto]), np.uint8))
        wordlike = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
        starts, ends = words.spans(np.where(wordlike, data, np.uint8(32)))
        limits = np.cumsum([len(e) + 1 for e in encoded[at:upto]])
        counts = np.diff(np.searchsorted(starts, limits), prepend=0)
        owner = at + np.repeat(np.arange(upto - at), counts)
        sums = words.running(data)
        for n in PREFIXES:
            long = np.flatnonzero(ends - starts > n)
            stop = starts[long] + n if n else ends[long]
            yield owner[long], words.span_hashes(sums, starts[long], stop) ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
        at = upto


@dataclass
class Terms:
    """The kept terms, sorted by hash, and a table that rules most other hashes out at once."""

    hashes: np.ndarray
    sieve: np.ndarray = field(init=False)

    def __post_init__(self):
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def counts(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term number, times) of the kept terms, sorted."""
        own, found = [], []
        for owner, hashes in term_hashes(texts):
            likely = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.searchsorted(self.hashes, hashes[likely])
            at[at == len(self.hashes)] = 0
            real = self.hashes[at] == hashes[likely] if len(self.hashes) else np.zeros(len(likely), bool)
            own.append(owner[likely][real])
            found.append(at[real])
        if not own:
            return (np.empty(0, np.int64),) * 3
        pair, times = np.unique(np.concatenate(own) * (len(self.hashes) + 1) + np.concatenate(found), return_counts=True)
        return pair // (len(self.hashes) + 1), pair % (len(self.hashes) + 1), times


def unit_vectors(text: np.ndarray, term: np.ndarray, times: np.ndarray, n: int, idf: np.ndarray) -> list[dict[int, float]]:
    """A vector of length 1 for each text; the constant term has the number after the last kept one."""
    rest = len(idf)
    weight = (1 + np.log(times)) * idf[term] if len(term) else np.empty(0)
    cuts = np.searchsorted(text, np.arange(n + 1))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        w = np.append(weight[a:b], REST_WEIGHT)
        w = np.round(w / np.sqrt((w * w).sum()), 9)
        out.append(dict(zip([*term[a:b].tolist(), rest], w.tolist())))
    return out


class BlockMaxIndex:
    """Postings of distinct vectors, in blocks, with the largest weight of each term in each block."""

    def __init__(self, vectors: list[dict[int, float]], toxic: np.ndarray, clean: np.ndarray, block: int = BLOCK):
        by_weight = sorted(range(len(vectors)), key=lambda i: sorted(vectors[i].items(), key=lambda x: (-x[1], x[0])))
        self.toxic, self.clean, self.block, self.size = toxic[by_weight], clean[by_weight], block, len(vectors)
        self.postings: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        held: dict[tuple[int, int], list] = {}
        for place, i in enumerate(by_weight):
            for term, weight in vectors[i].items():
                held.setdefault((term, place // block), []).append((place % block, weight))
        blocks = -(-len(vectors) // block)
        self.bounds: dict[int, np.ndarray] = {}
        for (term, b), rows in held.items():
            places, weights = zip(*rows)
            self.postings.setdefault(term, {})[b] = (np.array(places), np.array(weights))
            self.bounds.setdefault(term, np.zeros(blocks))[b] = max(weights)
        self.n_blocks = blocks

    def nearest(self, vector: dict[int, float], k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, cosines) of the `k` nearest examples, all ties of the last one included, nearest first.

        `without` is a vector of which one example does not count.
        """
        bound = np.zeros(self.n_blocks)
        for term, weight in vector.items():
            if term in self.bounds:
                bound += weight * self.bounds[term]
        found, cosines, examples = [], [], []
        least = -1.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] < least - 1e-12 or bound[b] <= 0:
                break
            score = np.zeros(self.block)
            for term, weight in vector.items():
                posting = self.postings.get(term, {}).get(b)
                if posting is not None:
                    score[posting[0]] += weight * posting[1]
            at = np.flatnonzero((score >= least - 1e-12) & (score > 0))
            found.append(at + b * self.block)
            cosines.append(score[at])
            place = np.concatenate(found)
            value = np.round(np.concatenate(cosines), 9)
            number = self.toxic[place] + self.clean[place] - (place == without if without is not None else 0)
            order = np.lexsort((place, -value))
            enough = np.searchsorted(np.cumsum(number[order]), k)
            if enough < len(order):
                least = value[order[enough]]
                keep = order[value[order] >= least]
                found, cosines = [place[keep]], [value[keep]]
            else:
                found, cosines = [place[order]], [value[order]]
        if not found:
            return np.empty(0, np.int64), np.empty(0)
        return found[0], cosines[0]


@dataclass
class Model:
    terms: Terms
    idf: np.ndarray
    index: BlockMaxIndex | None
    base: float
    toxic_weight: float = 1.0
    clean_weight: float = 1.0
    k: int = NEIGHBOURS
    votes: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    chances: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def vote(self, vector: dict[int, float], without: int | None = None, was_toxic: bool = False):
        place, cosine = self.index.nearest(vector, self.k, without)
        toxic, clean = self.index.toxic[place].astype(float), self.index.clean[place].astype(float)
        if without is not None:
            (toxic if was_toxic else clean)[place == without] -= 1
        # distance-weighted: a vector at half the way counts far less than an equal one
        near = 1.0 / (1.05 - cosine)
        yes, no = (near * toxic).sum() * self.toxic_weight, (near * clean).sum() * self.clean_weight
        prior = 0.5
        return (yes + prior * self.base) / (yes + no + prior), place, cosine

    def calibrated(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, self.votes, self.chances), 0.0, 1.0))


def _isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing function nearest to the labels (pool adjacent violators)."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # weight, weighted sum, lowest vote, highest vote
    for v, y, w in zip(votes[order].tolist(), labels[order].tolist(), weights[order].tolist()):
        pools.append([w, w * y, v, v])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            w2, s2, _, hi = pools.pop()
            pools[-1][0] += w2
            pools[-1][1] += s2
            pools[-1][3] = hi
    x, y = [], []
    for w, s, lo, hi in pools:
        mean = (s + 0.01) / (w + 0.02 / 1.0) if w > 0 else 0.0
        for v in ((lo, hi) if hi > lo else (lo,)):
            x.append(v)
            y.append(mean)
    return np.array(x), np.array(y)


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS, k: int = NEIGHBOURS,
) -> Model:
    """A model from the labelled rows outside the held-out fold: at most `max_examples` rows of each label."""
    marks = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
             .groupBy(F.col(key).alias("_key")).agg((F.max(label) == 1).alias("_toxic")))
    totals = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    base = n_toxic / max(n_toxic + n_clean, 1)
    if not n_toxic or not n_clean:
        return Model(Terms(np.empty(0, np.uint64)), np.empty(0), None, base)
    picked = marks.where("_toxic").orderBy(F.xxhash64("_key")).limit(max_examples).unionByName(
        marks.where("not _toxic").orderBy(F.xxhash64("_key")).limit(max_examples))
    # At most 2 * max_examples rows of a key and a label are broadcast.
    sample = materialise(
        docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key")
        .dropDuplicates(["_key"]), "toxicity-examples")
    sizes = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    s_toxic, s_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not s_toxic or not s_clean:
        return Model(Terms(np.empty(0, np.uint64)), np.empty(0), None, base)

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            toxic = frame["_toxic"].to_numpy(bool)
            pairs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for owner, hashes in term_hashes(frame["_text"].tolist()):
                order = np.lexsort((hashes, owner))
                o, h = owner[order], hashes[order]
                new = np.ones(len(o), bool)
                new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
                pairs[0].append(h[new])
                pairs[1].append(o[new])
            names, place = np.unique(np.concatenate(pairs[0]), return_inverse=True)
            yes = np.bincount(place, toxic[np.concatenate(pairs[1])], len(names)).astype(np.int64)
            every = np.bincount(place, minlength=len(names))
            yield pd.DataFrame({"term": names.view(np.int64), "yes": yes, "every": every})

    rows = sample.select("_text", "_toxic").mapInPandas(tally, "term long, yes long, every long").groupBy("term").agg(
        F.sum("yes").alias("yes"), F.sum("every").alias("every"))
    share_yes = F.col("yes") / s_toxic
    share_no = (F.col("every") - F.col("yes") + 0.5) / s_clean
    kept = (rows.where((F.col("yes") >= MIN_EXAMPLES) & (share_yes > MIN_RATIO * share_no))
            .orderBy((share_yes - share_no).desc(), "term").limit(max_terms).select("term").collect())
    terms = Terms(np.sort(np.array([r["term"] for r in kept], np.int64).view(np.uint64)))

    def frequency(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(terms.hashes), np.int64)
        n = 0
        for frame in frames:
            texts = frame["_text"].tolist()
            for a, b in words.slices(texts):
                total += np.bincount(terms.counts(texts[a:b])[1], minlength=len(total))
            n += len(texts)
        yield pd.DataFrame({"term": np.append(np.arange(len(total)), -1), "df": np.append(total, n)})

    df = {r["term"]: r["df"] for r in docs.select(F.col(text).alias("_text")).mapInPandas(
        frequency, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    n_docs = df.get(-1, 0)
    idf = np.array([np.log((1 + n_docs) / (1 + df.get(i, 0))) for i in range(len(terms.hashes))])

    # Examples as sparse counts of kept terms: bounded by examples times terms.
    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = unit_vectors(*terms.counts(frame["_text"].tolist()), len(frame), idf)
            yield pd.DataFrame({"toxic": frame["_toxic"], "terms": [list(v) for v in found],
                                "weights": [list(v.values()) for v in found]})

    examples = sample.select("_text", "_toxic").mapInPandas(
        vectors, "toxic boolean, terms array<long>, weights array<double>").groupBy("terms", "weights").agg(
        F.sum(F.col("toxic").cast("long")).alias("yes"), F.count("*").alias("n")).orderBy("terms", "weights").collect()
    index = BlockMaxIndex([dict(zip(r["terms"], r["weights"])) for r in examples],
                          np.array([r["yes"] for r in examples]), np.array([r["n"] - r["yes"] for r in examples]))
    model = Model(terms, idf, index, base, n_toxic / s_toxic, n_clean / s_clean, k)
    return _calibrate(model, examples)


def _calibrate(model: Model, examples) -> Model:
    """Leave-one-out votes of all examples, then isotonic regression."""
    order = sorted(range(len(examples)), key=lambda i: sorted(
        zip(examples[i]["terms"], examples[i]["weights"]), key=lambda x: (-x[1], x[0])))
    votes, labels, weights = [], [], []
    for place, i in enumerate(order):
        r = examples[i]
        vector = dict(zip(r["terms"], r["weights"]))
        for toxic, n, w in ((True, r["yes"], model.toxic_weight), (False, r["n"] - r["yes"], model.clean_weight)):
            if n:
                votes.append(model.vote(vector, place, toxic)[0])
                labels.append(float(toxic))
                weights.append(n * w)
    model.votes, model.chances = _isotonic(np.array(votes), np.array(labels), np.array(weights, float))
    return model


class Scorer:
    """Scores and evidence of texts; equal vectors are scored once in a task."""

    def __init__(self, model: Model, evidence: int = 3, held: int = 20_000):
        self.model, self.evidence, self.held, self.seen = model, evidence, held, {}

    def __call__(self, texts: list) -> list[tuple[float, list[dict]]]:
        model = self.model
        if model.index is None:
            return [(model.base, [])] * len(texts)
        return [self._of(v) for a, b in words.slices(texts)
                for v in unit_vectors(*model.terms.counts(texts[a:b]), b - a, model.idf)]

    def _of(self, vector: dict[int, float]) -> tuple[float, list[dict]]:
        name = tuple(vector.items())
        if name not in self.seen:
            if len(self.seen) >= self.held:
                self.seen.clear()
            vote, place, cosine = self.model.vote(vector)
            toxic, clean = self.model.index.toxic, self.model.index.clean
            self.seen[name] = self.model.calibrated(vote), [
                {"cosine": float(c), "toxic": int(toxic[p]), "clean": int(clean[p])}
                for p, c in zip(place[:self.evidence], cosine[:self.evidence])]
        return self.seen[name]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3,
          evidence: int = 3) -> DataFrame:
    """Every row's (key, held_out, score, predicted, evidence): the nearest example vectors as
    array<struct<cosine, toxic, clean>> with their numbers of examples per label."""
    kind = docs.schema[key].dataType.simpleString()

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model, evidence)
        for frame in frames:
            found = scorer(frame["_text"].tolist())
            yield pd.DataFrame({"key": frame["_key"], "score": [s for s, _ in found], "evidence": [e for _, e in found]})

    rows = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    found = rows.mapInPandas(
        judge, "key string, score double, evidence array<struct<cosine:double,toxic:long,clean:long>>")
    return found.select(
        F.col("key").cast(kind).alias(key), held_out(F.col("key")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is below the threshold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = scorer(batch.column(text).to_pylist())
            yield batch.filter(pa.array([s < threshold for s, _ in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
