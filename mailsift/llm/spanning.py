"""Links between components of one cluster: exact comparison of the members that first links left apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import join_small
from ..storage import materialise
from .components import components

#: Classes that the values of a set are counted by, for a bound on what two sets can have in common.
CLASSES = 256
#: Pairs whose bounds are made at a time.
PAIRS = 2048


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have `percent` of their union in common."""
    if not len(x) or not len(y):
        return False
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def open_members(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(cluster, node, root, n) of the clusters of `edges` (a, b) that hold several components; n is their members' number."""
    clusters = components(edges, roots).withColumnRenamed("root", "cluster")
    standing = materialise(clusters.join(roots, "node", "left").select(
        "cluster", "node", F.coalesce("root", "node").alias("root")), "clusters")
    split = standing.groupBy("cluster").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo != hi and n > 2")
    return standing.join(split.select("cluster", "n"), "cluster")


def open_clusters(clusters: DataFrame, roots: DataFrame) -> DataFrame:
    """The same, from known clusters (node, root); members of a large cluster are shared out over tasks."""
    standing = materialise(clusters.withColumnRenamed("root", "cluster").join(roots, "node", "left").select(
        "cluster", "node", F.coalesce("root", "node").alias("root")), "clusters")
    split = standing.groupBy("cluster").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo != hi and n > 2")
    return join_small(standing, split.select("cluster", "n"), ["cluster"], "node")


def packed_sets(column: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column]


def _found(frame: pd.DataFrame, left: np.ndarray, right: np.ndarray, percent: int, likely, unpack) -> pd.DataFrame:
    """The links (a, b) that join components, of rows `left` of the frame with rows `right`; both in order."""
    one, two = np.repeat(left, len(right)), np.tile(right, len(left))
    if np.array_equal(left, right):
        later = two > one
        one, two = one[later], two[later]
    return _joining(frame, one, two, percent, likely, unpack)


def _joining(frame: pd.DataFrame, one: np.ndarray, two: np.ndarray, percent: int, likely, unpack) -> pd.DataFrame:
    """The links (a, b) that join components, of the pairs of rows (one, two) in their order."""
    roots = frame["root"].to_numpy(np.int64).copy()
    apart = roots[one] != roots[two]
    one, two = one[apart], two[apart]
    sets = unpack(frame["set"].tolist())
    nodes = frame["node"].to_numpy(np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    near = 100 * np.minimum(sizes[one], sizes[two]) >= percent * np.maximum(sizes[one], sizes[two])
    one, two = one[near], two[near]
    if likely and len(one):
        sketches = np.stack(frame["sketch"].to_list()).view(np.uint64)
        cuts = np.flatnonzero(np.diff(one)) + 1
        keep = np.concatenate([likely(sketches[i[0]], sketches[j]) for i, j in zip(np.split(one, cuts), np.split(two, cuts))])
        one, two = one[keep], two[keep]
    if not len(one):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    # two sets have no more in common than class by class
    classes = (np.concatenate(sets) >> np.uint64(32)).astype(np.int64) % CLASSES
    classes += np.repeat(np.arange(len(sets)) * CLASSES, sizes)
    counts = np.bincount(classes, minlength=len(sets) * CLASSES).reshape(-1, CLASSES)
    counts = counts.astype(np.uint16 if counts.max() < 1 << 16 else np.int64)
    most = np.concatenate([np.minimum(counts[one[k:k + PAIRS]], counts[two[k:k + PAIRS]]).sum(axis=1, dtype=np.int64)
                           for k in range(0, len(one), PAIRS)])
    near = 100 * most >= percent * (sizes[one] + sizes[two] - most)
    out = []
    for i, j in zip(one[near].tolist(), two[near].tolist()):
        if roots[i] != roots[j] and alike(sets[i], sets[j], percent):
            roots[roots == max(roots[i], roots[j])] = min(roots[i], roots[j])
            out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
    return pd.DataFrame(out, columns=["a", "b"])


def stray_links(members: DataFrame, percent: int, block: int, likely=None, unpack=packed_sets) -> DataFrame:
    """Links (a, b) between components, of each stray member of a bucket with all members of the bucket.

    `members` are (bucket, node, stray, strays, n, root, set[, sketch]), `strays` and `n` the numbers in the bucket.  Strays
    and members are dealt into blocks and each pair of blocks is one group, so a large bucket is many tasks.
    """
    name = F.xxhash64("node", "bucket")
    rows, columns = F.ceil(F.col("strays") / block).cast("int"), F.ceil(F.col("n") / block).cast("int")
    fields = [c for c in ("node", "root", "set", "sketch") if c in members.columns]
    as_stray = members.where("stray").select(
        "bucket", F.lit(True).alias("left"), F.pmod(name, rows).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), columns - 1)).alias("y"), *fields)
    as_member = members.select(
        "bucket", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("x"),
        F.pmod(name, columns).cast("int").alias("y"), *fields)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["left", "node"]).reset_index(drop=True)
        left = frame["left"].to_numpy(bool)
        return _found(frame, np.flatnonzero(left), np.flatnonzero(~left), percent, likely, unpack)

    return as_stray.unionByName(as_member).groupBy("bucket", "x", "y").applyInPandas(compare, "a long, b long")


def spanning_links(members: DataFrame, percent: int, block: int, likely=None, unpack=packed_sets) -> DataFrame:
    """Links (a, b) between components, from members (cluster, node, root, n, set[, sketch]).

    A cluster's members are dealt into blocks and each pair of blocks is one group, so a large cluster is many tasks.
    Clusters of one block are worked on together, about a block of members at a time.  Inside a group components are joined
    as links are found, and only links that join two of them are sent: at most one less than the members, however many
    pairs are alike.  `likely(sketch, sketches)` may rule pairs out first; `unpack` makes sorted arrays of the values of `set`.
    """
    dealt = members.where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = dealt.withColumn("own", F.pmod(F.xxhash64("node", "cluster"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "blocks", "n")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = int(frame["x"].iat[0]), int(frame["y"].iat[0])
        frame = frame.drop_duplicates(["node", "own"]).sort_values(["own", "node"]).reset_index(drop=True)
        own = frame["own"].to_numpy()
        return _found(frame, np.flatnonzero(own == x), np.flatnonzero(own == y), percent, likely, unpack)

    def compare_small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_clusters(frames, block):
            yield _joining(frame, *pairs_of(frame["cluster"].to_numpy()), percent, likely, unpack)

    fields = [c for c in ("cluster", "node", "root", "set", "sketch") if c in members.columns]
    small = members.where(F.col("n") <= block).select(*fields).repartition("cluster").sortWithinPartitions("cluster", "node")
    large = met.groupBy("cluster", "x", "y").applyInPandas(compare, "a long, b long")
    return large.union(small.mapInPandas(compare_small, "a long, b long"))


def whole_clusters(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Rows in order of `cluster`, in frames of at least `least` rows (but the last) that hold whole clusters."""
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        at = 0
        for cut in (np.flatnonzero(np.diff(held["cluster"].to_numpy())) + 1).tolist():
            if cut - at >= least:
                yield held.iloc[at:cut].reset_index(drop=True)
                at = cut
        held = held.iloc[at:]
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def pairs_of(clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows (one, two), the earlier first, of equal values that stand together."""
    ends = np.append(np.flatnonzero(np.diff(clusters)) + 1, len(clusters))
    row = np.arange(len(clusters))
    later = ends[np.searchsorted(ends, row, side="right")] - row - 1
    one = np.repeat(row, later)
    return one, one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later)
