"""An inverted-file index of vectors: lists around k-means centroids, searched by probing the lists nearest to a query.

Centroids are trained on a sample of bounded size that is drawn from the whole table by a hash of the key; every vector is
then put into the list of its nearest centroid, and lists are stored in folders by their number.  A search scores the
vectors of the `probes` nearest lists exactly.  With `exact`, a second round reads every further list that may still hold one
of the best: the angle between a query and any vector of a list is at least the angle to the centroid less the list's radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import materialise
from .bm25 import only
from .ranking import top_k
from .vectors import BLOCK_ROWS, _copies, _keyed, _queries, _spread, _units, best_pairs, group_counts, score_groups

#: Vectors that centroids are trained on, at most; the number of centroids is bounded by it too.
SAMPLE_ROWS = 100_000
ITERATIONS = 10
BUCKETS = 64
VECTORS_PER_FILE = 500_000
#: Scores are rounded and angles are floating point: bounds are loosened by this much.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorLists:
    """`vectors` (bucket, list, key, vector), and of every list that is not empty its number, centroid, radius and size."""

    vectors: DataFrame
    numbers: np.ndarray
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    buckets: int


def train_centroids(vectors: DataFrame, lists: int, sample_rows: int = SAMPLE_ROWS, iterations: int = ITERATIONS,
                    seed: int = 1) -> np.ndarray:
    """Unit centroids of `lists` clusters by cosine, from the `sample_rows` non-zero vectors with the least hash of the key."""
    held = _keyed(vectors).where(F.exists("vector", lambda x: x != 0))
    sample = held.orderBy(F.xxhash64("key"), "key").limit(max(sample_rows, lists))
    rows = materialise(sample.select(array_to_vector("vector").alias("features")), "centroid-sample")
    if rows.isEmpty():
        raise ValueError("no vector to train centroids on")
    model = KMeans(k=max(lists, 2), distanceMeasure="cosine", maxIter=iterations, seed=seed).fit(rows)
    return _units(model.clusterCenters())


def write_lists(vectors: DataFrame, path: str, lists: int, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> None:
    """Write the index of `vectors` (no, vector) to a new path."""
    spark = vectors.sparkSession
    centroids = train_centroids(vectors, lists, sample_rows)
    sent = spark.sparkContext.broadcast(centroids)
    held = _keyed(vectors)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = _units(batch.vector) @ sent.value.T
                best = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
                yield batch.assign(list=best, angle=angle)

    kind = held.schema["vector"].dataType.simpleString()
    dealt = held.mapInPandas(assign, f"key string, vector {kind}, list int, angle double")
    dealt = dealt.withColumn("bucket", F.pmod("list", F.lit(buckets)))
    spread = F.pmod(F.xxhash64("key"), F.lit(1 + held.count() // VECTORS_PER_FILE))
    (dealt.repartition("bucket", spread).sortWithinPartitions("bucket", "list")
     .write.partitionBy("bucket").parquet(f"{path}/vectors"))
    stored = spark.read.parquet(f"{path}/vectors").groupBy("list").agg(
        F.max("angle").alias("radius"), F.count("*").alias("size"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    table.join(stored, "list").withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/lists")


def read_lists(spark: SparkSession, path: str) -> VectorLists:
    rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # as many as there are lists
    return VectorLists(
        spark.read.parquet(f"{path}/vectors"), np.array([r["list"] for r in rows]), np.array([r["centroid"] for r in rows]),
        np.array([r["radius"] for r in rows]), np.array([r["size"] for r in rows]), rows[0]["buckets"])


def _probed(index: VectorLists, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, vector, list): the nearest lists of each query, as `_wanted` gives them."""
    return _wanted(index, queries, probes).select("query_id", "vector", F.explode("lists").alias("list"))


def _wanted(index: VectorLists, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, vector, near, lists): the nearest lists of each query or, where a query has a `least` score, those beyond
    the nearest that may hold a vector with that score; `near` is the nearest."""
    sent = queries.sparkSession.sparkContext.broadcast((index.numbers, index.centroids, index.radii))
    again = "least" in queries.columns

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, centroids, radii = sent.value
        for batch in batches:
            if not len(batch):
                continue
            near = _units(batch.vector) @ centroids.T
            order = np.argsort(-near, axis=1, kind="stable")
            wanted = np.zeros(near.shape, bool)
            np.put_along_axis(wanted, order[:, :probes], True, axis=1)
            if again:
                angle = np.maximum(np.arccos(np.clip(near, -1, 1)) - radii - SLACK, 0)
                wanted = ~wanted & (np.cos(angle) + SLACK >= batch.least.to_numpy()[:, None])
                # A zero vector, on either side, has an angle to nothing: its scores are 0.
                zero = ~np.array([np.any(v) for v in batch.vector])
                wanted |= (zero | (batch.least.to_numpy() <= SLACK))[:, None] & ~_first(order, probes)
            lists = pd.Series([numbers[w] for w in wanted], dtype=object, index=batch.index)
            yield batch[["query_id", "vector"]].assign(near=numbers[order[:, 0]], lists=lists)[wanted.any(axis=1)]

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    columns = ["query_id", "vector", *(["least"] if again else [])]
    return queries.select(*columns).mapInPandas(
        choose, f"query_id {kinds['query_id']}, vector {kinds['vector']}, near int, lists array<int>")


def _first(order: np.ndarray, probes: int) -> np.ndarray:
    marks = np.zeros(order.shape, bool)
    np.put_along_axis(marks, order[:, :probes], True, axis=1)
    return marks


def _scored(index: VectorLists, asked: DataFrame, k: int, allowed: DataFrame | None, block_rows: int) -> DataFrame:
    """Scored pairs of the queries and the vectors of their lists, or of the `list` that each row names.

    Queries with the same nearest list are in one group or in neighbouring ones; a group gets the vectors of the lists that
    its queries ask for, and only folders of asked lists are read.
    """
    if "list" in asked.columns:
        asked = asked.select("query_id", "vector", F.col("list").alias("near"), F.array("list").alias("lists"))
    asked = materialise(asked.withColumnRenamed("lists", "codes"), "probes")
    query_groups, vector_groups = group_counts(asked, index.vectors, block_rows)
    counts = asked.groupBy("near").agg(F.count("*").alias("n")).orderBy("near").collect()  # as many as there are lists
    sizes = [r["n"] for r in counts]
    starts = np.cumsum([0, *sizes])[:-1].tolist()
    per_group = -(-sum(sizes) // query_groups)
    places = asked.sparkSession.createDataFrame(
        [(r["near"], start, r["n"]) for r, start in zip(counts, starts)], "near int, start long, n long")
    place = F.col("start") + F.pmod(F.xxhash64("query_id"), F.col("n"))
    grouped = asked.join(places, "near").select("query_id", "vector", "codes", F.floor(place / per_group).cast("int").alias("qg"))
    wants = materialise(grouped.select("qg", F.explode("codes").alias("list")).distinct(), "group-lists")
    folders = [r["bucket"] for r in wants.select(F.pmod("list", F.lit(index.buckets)).alias("bucket")).distinct().collect()]
    held = only(index.vectors.where(F.col("bucket").isin(folders)), None if allowed is None else allowed.select(
        F.col("no").cast("string").alias("key")), "key")
    right = held.join(wants, "list").select("key", "vector", "qg", F.array("list").alias("codes")).withColumn(
        "vg", _spread("key", vector_groups))
    group = (F.col("qg") * vector_groups + F.col("vg")).alias("group")
    left = grouped.withColumn("vg", _copies(vector_groups))
    return score_groups(left.select("*", group), right.select("*", group), query_groups * vector_groups, k, block_rows)


def nearest_by_lists(queries: DataFrame, index: VectorLists, k: int, probes: int, exact: bool = False,
                     allowed: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The best `k` vectors of the `probes` lists nearest to each query or, if `exact`, of all vectors.

    Lists do not overlap, so no pair is scored twice.  Only `allowed` mails (a table with `no`) take part.
    """
    asked = _queries(queries)
    pairs = _scored(index, _wanted(index, asked, probes), k, allowed, block_rows)
    if not exact:
        return best_pairs(pairs, k)
    pairs = materialise(pairs, "first-probes")
    ends = top_k(pairs, ["query_id"], [F.col("cosine_score").desc(), F.col("key")], k).groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("cosine_score").alias("kth"))
    least = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(-2.0))  # too few found: every list may matter
    bounded = asked.join(ends, "query_id", "left").select("query_id", "vector", F.coalesce(least, F.lit(-2.0)).alias("least"))
    further = _scored(index, _wanted(index, bounded, probes), k, allowed, block_rows)
    return best_pairs(pairs.unionByName(further), k)


def probed_share(queries: DataFrame, index: VectorLists, probes: int) -> float:
    """Pairs that a search with so many probes scores, by all pairs there are."""
    counts = _probed(index, _queries(queries), probes).groupBy("list").agg(F.count("*").alias("n")).collect()
    sizes = dict(zip(index.numbers.tolist(), index.sizes.tolist()))
    every = max(1, _queries(queries).count() * int(index.sizes.sum()))
    return sum(r["n"] * sizes[r["list"]] for r in counts) / every
