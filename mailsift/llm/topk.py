"""Exact top-k search by inner product, with the three-phase uniform threshold.

Vectors are whole numbers, cut into `segments` of their components.  The inner product of a query and a row is the sum of
its segment scores, so each segment is a list of local scores:

1. Each list sends its k best rows of each query.  The exact scores of these rows give a safe cutoff: the k-th best of them.
2. A row at or above the cutoff has at least the uniform threshold, cutoff / segments, in some list (if all of its segment
   scores were below, so would be their sum).  Each list sends all rows at or above the threshold; rows whose lists, all
   known to the task, add up to less than the cutoff stay behind.
3. The rows sent are resolved exactly, and the k best are ranked; ties go to the smaller key.

Equal vectors are one row with their k + 1 smallest keys, which is exact because ties go by key; a vector that a third of
all rows share is scored once.  Queries and rows meet in blocks: a grid of query blocks and row blocks, each pair one
task's matrix product, a slice of queries at a time; only the rows that a phase sends leave it.

Defined results: vectors that are null or hold null or non-finite components take no part, as query or row; an empty vector has no
components and scores 0; vectors of different lengths have no product and do not meet; a query is no answer to itself; rows with equal
keys are one row per key and vector; fewer than k other rows give as many as there are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..storage import materialise

SEGMENTS = 2
SCALE = 256
#: Rows and queries in one block of the grid.
ROW_BLOCK = 16_384
QUERY_BLOCK = 8_192
#: Queries of a block that are scored at once, and the share of the norms by which rounding may change a score.
QUERY_SLICE = 256
SLACK = 1e-12


def whole(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(key, v array<long>) with floor(scale * x) of each component, of the vectors that take part."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & usable).select(
        F.col(key).cast("long").alias("key"), F.transform(numbers, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(rows, start: int, stop: int | None) -> np.ndarray:
    """Exact in floating point while sums of products stay below 2^53."""
    return np.stack([r[start:stop] for r in rows]).astype(np.float64)


def _grid(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> DataFrame:
    """Both sides dealt into blocks, with one row per vector and block of the other side."""
    lb, rb = -(-n_left // QUERY_BLOCK) or 1, -(-n_right // ROW_BLOCK) or 1
    q = left.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(lb))).withColumn(
        "rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1)))).withColumn("side", F.lit(True))
    r = right.withColumn("rb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rb))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(lb - 1)))).withColumn("side", F.lit(False))
    names = ["qb", "rb", "side", "id", "v", "cutoff"]
    return q.select([F.col(c).cast("long") if c in ("qb", "rb") else F.col(c) for c in names]).unionByName(
        r.withColumn("cutoff", F.lit(None).cast("double")).select(
            [F.col(c).cast("long") if c in ("qb", "rb") else F.col(c) for c in names]))


def _cuts(length: int, segments: int) -> list[tuple[int, int]]:
    at = [length * i // segments for i in range(segments + 1)]
    return list(zip(at[:-1], at[1:]))


def _list_scores(frame: pd.DataFrame, segments: int):
    """(queries, their matrix, rows, their matrix, scores of each list) for vectors of one length, a slice of queries at a time.

    Scores are made list by list as they are asked for, so a task holds the scores of one slice and not of a whole block.
    """
    for _, part in frame.groupby(frame["v"].map(len)):
        q, r = part[part["side"]], part[~part["side"]]
        if len(q) and len(r):
            rows = _matrix(r["v"], 0, None)
            cuts = _cuts(rows.shape[1], segments)
            for start in range(0, len(q), QUERY_SLICE):
                some = q.iloc[start:start + QUERY_SLICE]
                asked = _matrix(some["v"], 0, None)
                yield some, asked, r, rows, (asked[:, a:b] @ rows[:, a:b].T for a, b in cuts)


def _pairs(out: list[np.ndarray]) -> pd.DataFrame:
    both = np.concatenate([np.empty((2, 0), np.int64), *out], axis=1)
    return pd.DataFrame({"query": both[0], "row": both[1]})


def _local_best(k: int, segments: int):
    """Phase 1: the k best rows of each query in each list."""
    def find(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, _, r, _, lists in _list_scores(frame, segments):
            ids, qid = r["id"].to_numpy(np.int64), q["id"].to_numpy(np.int64)
            for scores in lists:
                np.negative(scores, out=scores)
                best = np.argpartition(scores, min(k, len(r)) - 1, axis=1)[:, :k]
                out.append(np.stack([np.repeat(qid, best.shape[1]), ids[best].ravel()]))
        return _pairs(out)
    return find


def _above(segments: int):
    """Phase 2: the rows of a query at or above its threshold in some list, without those whose lists add up to less than the
    cutoff: they are known here, and phase 3 would resolve them for nothing."""
    def find(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, asked, r, rows, lists in _list_scores(frame, segments):
            ids, qid = r["id"].to_numpy(np.int64), q["id"].to_numpy(np.int64)
            least = q["cutoff"].fillna(-np.inf).to_numpy()[:, None]
            hit, total = np.zeros((len(q), len(r)), bool), np.zeros((len(q), len(r)))
            for scores in lists:
                hit |= segments * scores >= least
                total += scores
            # Sums are exact but for very large numbers; what rounding could hide there is sent.
            hit &= total >= least - SLACK * np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(rows, axis=1).max()
            at = np.nonzero(hit)
            out.append(np.stack([qid[at[0]], ids[at[1]]]))
        return _pairs(out)
    return find


def _scored(pairs: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, row, score): exact products of the pairs."""
    product = F.aggregate(F.zip_with("qv", "rv", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
    return (pairs.join(queries.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query")
            .join(rows.select(F.col("id").alias("row"), F.col("v").alias("rv")), "row")
            .select("query", "row", product.alias("score")))


def _expanded(scored: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) for the keys behind each pair, without the query itself."""
    return (scored.join(queries.select(F.col("id").alias("query"), F.col("key").alias("query_id")), "query")
            .join(rows.select(F.col("id").alias("row"), "keys"), "row")
            .select("query_id", F.explode("keys").alias("vec_id"), "score").where("vec_id != query_id"))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    segments: int = SEGMENTS, scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of `vectors` for each row of `queries`, own key left out."""
    rows = _distinct(whole(vectors, key, vector, scale), k)
    rows = materialise(rows, "search-rows")
    asked = materialise(whole(queries, key, vector, scale).distinct().withColumn("id", F.col("key")), "search-queries")
    n_rows, n_asked = rows.count(), asked.count()
    if not n_rows or not n_asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    none = F.lit(None).cast("double")
    lists = _grid(asked.withColumn("cutoff", none), rows, n_asked, n_rows)
    first = lists.groupBy("qb", "rb").applyInPandas(_local_best(k + 1, segments), "query long, row long").distinct()
    scored = materialise(_scored(first, asked, rows), "search-first")
    # The k-th best exact score of the rows seen is a lower bound of the k-th best of all.
    heads = _expanded(scored, asked, rows).groupBy("query_id", "score").agg(F.count("*").alias("n"))
    cutoff = heads.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("score", "n")), asc=False).alias("s")).select(
        F.col("query_id").alias("id"),
        F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), none.alias("cut")), lambda a, x: F.when(
            a["n"] >= k, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), F.when(
                a["n"] + x["n"] >= k, x["score"].cast("double")).alias("cut"))))["cut"].alias("cutoff"))
    cutoff = materialise(cutoff, "search-cutoffs")
    grid = _grid(asked.join(cutoff, "id", "left"), rows, n_asked, n_rows)
    enough = grid.groupBy("qb", "rb").applyInPandas(_above(segments), "query long, row long")
    resolved = _expanded(_scored(enough.distinct(), asked, rows), asked, rows)
    ranked = resolved.distinct().groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("place", "t")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"),
        (-F.col("t.minus")).alias("score"))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(id, v, keys): one row per vector with its k + 1 smallest keys, by repeated minima with map-side combine."""
    held = materialise(rows.distinct(), "search-keys")
    names = ["k0"]
    out = held.groupBy("v").agg(F.min("key").alias("k0"), F.count("*").alias("n"))
    many = held.join(out.where("n > 1").select("v"), "v", "left_semi")
    for i in range(1, k + 1):
        before = out.where(f"k{i - 1} is not null").select(F.col("v"), F.col(f"k{i - 1}").alias("last"))
        least = many.join(before, "v").where("key > last").groupBy("v").agg(F.min("key").alias(f"k{i}"))
        out = out.join(least, "v", "left")
        names.append(f"k{i}")
    return out.select(F.col("k0").alias("id"), "v", F.filter(F.array(*names), lambda x: x.isNotNull()).alias("keys"))
