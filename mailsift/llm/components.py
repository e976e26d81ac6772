"""Distributed union-find: the connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import materialise


def components(links: DataFrame, known: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in `links` (a, b) and in `known`: root is the smallest node that can be reached.

    `known` are the components (node, root) of links found before; only what `links` adds to them is worked on.

    In each round every node hooks itself to its smallest smaller neighbour.  The trees that this gives become stars by
    pointer jumping, and the next round sees links between roots only, until none is left.  Every step is an aggregate
    with map-side combine or a join on node numbers.  No component is ever gathered in one place, and each step is a stored
    table.
    """
    nodes = None if known is None else known.where("node != root")
    edges = materialise(_between(links, nodes), "links")
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        stars = _stars(edges.groupBy("a").agg(F.min("b").alias("b")), max_rounds)
        nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("root")) if nodes is None else _hooked(nodes, stars)
        edges = materialise(_between(edges, nodes), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if nodes is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return materialise(nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct()), "roots")


def between(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """`links` (a, b, ...) with the roots `ra` and `rb` of both ends, without links inside a component."""
    a = nodes.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = nodes.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return (links.join(a, "a", "left").join(b, "b", "left")
            .withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b")).where("ra != rb"))


def _between(links: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """The distinct links between roots, the larger one first."""
    if nodes is not None:
        links = between(links, nodes).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(trees: DataFrame, max_rounds: int) -> DataFrame:
    """Trees given as (a, b), b the parent of a, with b the root of a: each step halves the depth."""
    for _ in range(max_rounds):
        above = trees.select(F.col("a").alias("b"), F.col("b").alias("above"))
        trees = materialise(trees.select("a", "b").join(above, "b", "left").select(
            "a", F.coalesce("above", "b").alias("b"), F.col("above").isNotNull().alias("moved")), "links")
        if trees.where("moved").isEmpty():
            return trees.select("a", "b")
    raise RuntimeError(f"trees did not settle in {max_rounds} rounds")


def _hooked(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """`nodes` whose roots have found roots of their own, and these roots as nodes."""
    stars = stars.withColumnsRenamed({"a": "root", "b": "above"})
    moved = nodes.join(stars, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return materialise(moved.union(stars.select(F.col("root").alias("node"), F.col("above").alias("root"))), "nodes")
