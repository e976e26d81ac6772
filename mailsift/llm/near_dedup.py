"""Near-duplicate documents: MinHash bands, odd sketches, exact set checks, components.

1. Each document becomes the set of the hashes of its word shingles.  Documents with equal sets are one class; the
   smallest key of a class represents it.
2. MinHash samples of a set are cut into bands; representatives that share a band are candidates.  With 32 bands of 4
   rows, two sets at a similarity of 0.8 miss each other with a chance of about 5e-8.
3. Samples are also folded into an odd sketch, a bitmap of parities.  The XOR of two sketches counts the samples that
   differ, which estimates high similarities precisely, so that only near candidates are checked.
4. Links are confirmed on whole sets.

In a band's bucket every member is first compared with the bucket's leader, which is another member in each band.
Confirmed links give components.  Members of one cluster (nodes that hang together by sketches at a lower similarity) that
are still in different components are then compared with each other, block by block; members of one component need no more
links.  A member of a bucket that its leader did not draw into a cluster (a stray) is compared with all members of the
bucket that are in other components.  So every pair of documents that share a band is linked, in one component, or
compared, and no link between components is lost.  A group of any size is linear in its members while it hangs together;
a bucket costs its strays times its members.

Defined results: words are runs of `[^\\x20\\x09-\\x0D]` with A-Z in lower case; a text with fewer words than a shingle is
one shingle; null texts and texts without words have an empty set and link with nothing; rows with a null key are kept,
with themselves as component (null); rows with equal keys are one node; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import materialise
from . import words
from .components import between, components
from .spanning import alike, open_members, spanning_links, stray_links

SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 32, 4
SKETCH_BITS = 1024
#: Candidates whose estimate is below this are not checked.  128 samples put the estimate of a similarity of 0.8 below it
#: with a chance of about 1e-7.
SKETCH_LEAST = 0.6
#: Pairs from this estimate on belong to one cluster.
CLUSTER_LEAST = 0.5
#: Members of a cluster that are compared with each other in one task.
BLOCK = 512


def shingle_sets(texts: list, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = words.Texts(texts, lower=True)
    windows = words.window_hashes(found.hashes, size)
    out = []
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(windows[a:b - size + 1]))
        elif b > a:
            # the whole sequence; its length keeps it apart from shingles
            out.append(words.window_hashes(found.hashes[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _permutations(n: int) -> np.ndarray:
    return words.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def min_hashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """`n` MinHash samples of each non-empty set; one row per set."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), n), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        # 32 bits are enough for a sample and go through memory faster
        flat = ((flat >> np.uint64(32)) ^ flat).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        work = np.empty_like(flat)
        for k, factor in enumerate(_permutations(n)):
            odd = np.uint32(int(factor) & 0xFFFFFFFF | 1)
            np.bitwise_xor(flat, np.uint32(int(factor) >> 32), out=work)
            np.multiply(work, odd, out=work)
            np.bitwise_xor(work, work >> np.uint32(15), out=work)
            np.multiply(work, np.uint32(0x2C1B3C6D), out=work)
            out[full, k] = np.minimum.reduceat(work, starts)
    return out


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of the samples: bit h is set if an odd number of (place, sample) pairs falls on h."""
    place = np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(32)
    at = (words.mix(samples.astype(np.uint64) | place) % np.uint64(bits)).astype(np.int64)
    grid = np.zeros((len(samples), bits), np.uint8)
    np.add.at(grid, (np.arange(len(samples))[:, None], at), 1)
    return np.packbits(grid & 1, axis=1)


def sketch_similarity(a: Column, b: Column, samples: int, bits: int = SKETCH_BITS) -> Column:
    """The similarity that two odd sketches (array<long>) estimate; -1 if nearly half of the bits differ."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    share = apart / F.lit(bits)
    # n different samples put 2n balls; the expected share of odd bits is (1 - exp(-4n / bits)) / 2
    differing = -F.log(F.greatest(1 - 2 * share, F.lit(1e-9))) * (bits / 4)
    return F.when(share >= 0.48, F.lit(-1.0)).otherwise(1 - differing / samples)


def _estimate(a: np.ndarray, b: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """The same estimate for rows of bitmaps."""
    share = np.bitwise_count(a ^ b).sum(-1) / bits
    return np.where(share >= 0.48, -1.0, 1 + np.log(np.maximum(1 - 2 * share, 1e-9)) * (bits / 4) / samples)


def signatures(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(node, n_shingles, set_id, bands, sketch) of every row; an empty set is equal to no other and has no bands."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, keys = frame["_text"].tolist(), frame["_key"].tolist()
            for at, upto in words.slices(texts):
                sets = shingle_sets(texts[at:upto], size)
                samples = min_hashes(sets, bands * rows)
                band = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    band = band * np.uint64(0x9E3779B97F4A7C15) + samples[:, r::rows][:, :bands].astype(np.uint64)
                band = words.mix(band + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                sketches = odd_sketches(samples)
                out = []
                for i, (k, s) in enumerate(zip(keys[at:upto], sets)):
                    names = [int(words.mix(s ^ np.uint64(seed)).sum(dtype=np.uint64)) - (1 << 63) for seed in (1, 2)]
                    out.append((k, len(s), f"{len(s)}|{names[0]}|{names[1]}" if len(s) else f"0|{k}",
                                band[i].tolist() if len(s) else [], sketches[i].view(np.int64).tolist()))
                yield pd.DataFrame(out, columns=["node", "n_shingles", "set_id", "bands", "sketch"])

    pairs = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    return pairs.mapInPandas(sign, "node string, n_shingles long, set_id string, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(node, set) of the wanted nodes: their shingle hashes, packed.  One row per node."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["_text"].tolist()
            for a, b in words.slices(texts):
                yield pd.DataFrame({"node": frame["_key"].iloc[a:b],
                                    "set": [s.tobytes() for s in shingle_sets(texts[a:b], size)]})

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(
        wanted.withColumnRenamed("node", "_key"), "_key", "left_semi")
    return rows.mapInPandas(pack, "node long, set binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(frame["set_a"], frame["set_b"])]
            yield frame.loc[good, ["a", "b"]]

    rows = (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b"))
    return rows.select("a", "b", "set_a", "set_b").mapInPandas(check, "a long, b long")


def _strays(crowded: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, stray, strays, n, root) of the buckets in which a stray has a member of another component beside the leader.

    `crowded` are (bucket, node, leader); a stray is a member without an edge (a, b) to its leader.
    """
    drawn = crowded.where("node != leader").withColumns({"a": F.greatest("node", "leader"), "b": F.least("node", "leader")}).join(
        edges.select("a", "b", F.lit(True).alias("drawn")), ["a", "b"], "left")
    standing = drawn.select("bucket", "node", F.col("drawn").isNull().alias("stray")).join(roots, "node", "left").select(
        "bucket", "node", "stray", F.coalesce("root", "node").alias("root"))
    split = standing.groupBy("bucket").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"),
        F.count_if("stray").alias("strays")).where("lo != hi and strays > 0")
    return standing.join(split.select("bucket", "strays", "n"), "bucket")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT,
    bands: int = BANDS, rows: int = ROWS, least: float = SKETCH_LEAST, block: int = BLOCK,
) -> DataFrame:
    """Every row's (key, n_shingles, component_id, kept, class_id).

    Documents link if their sets have `percent` of their union in common; component_id is the smallest key that can be
    reached over links, kept marks the row with that key.  class_id is the smallest key with the same set.  Keys are
    whole numbers.
    """
    samples = bands * rows
    signed = materialise(signatures(docs, key, text, size, bands, rows).withColumn(
        "node", F.col("node").cast("long")), "signatures")
    # One row per class, by an aggregate with map-side combine: copies are never gathered.
    classes = signed.where("n_shingles > 0 and node is not null").groupBy("set_id").agg(
        F.min(F.struct("node", "bands", "sketch")).alias("head")).select(
        "set_id", F.col("head.node").alias("class_id"), "head.bands", "head.sketch")
    classes = materialise(classes, "classes")
    heads = classes.select(F.explode("bands").alias("bucket"), F.col("class_id").alias("node"))
    # Another order in each bucket, so that a node meets another leader in each band.
    order = F.struct(F.xxhash64("node", "bucket").alias("h"), "node")
    buckets = heads.groupBy("bucket").agg(F.min(order).alias("m"), F.count("*").alias("n")).where("n > 1").select(
        "bucket", F.col("m.node").alias("leader"))
    crowded = materialise(heads.join(buckets, "bucket"), "buckets")
    sketches = classes.select(F.col("class_id").alias("node"), "sketch")
    pairs = crowded.where("node != leader").select(
        F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
    near = (pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
            .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
            .select("a", "b", sketch_similarity(F.col("sa"), F.col("sb"), samples).alias("estimate"))
            .where(F.col("estimate") >= CLUSTER_LEAST))
    edges = materialise(near, "near")
    near = edges.where(F.col("estimate") >= least)
    sets = materialise(_sets(docs, crowded.select("node").distinct(), key, text, size), "sets")
    # The most similar partner of each node first; the others only where that left two components.
    first = near.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("m")).select("a", "m.b")
    linked = materialise(_confirmed(first, sets, percent), "confirmed")
    roots = components(linked)
    rest = between(near.select("a", "b"), roots).select("a", "b").join(first, ["a", "b"], "left_anti")
    roots = components(_confirmed(rest, sets, percent), roots)
    # What the leaders left apart.
    open_ = open_members(edges, roots).join(sets, "node").join(sketches, "node")

    def likely(own, others):
        return _estimate(others, own, samples, SKETCH_BITS) >= least

    across = materialise(spanning_links(open_, percent, block, likely), "across")
    roots = components(across, roots)
    strays = materialise(_strays(crowded, edges, roots), "strays").join(sets, "node").join(sketches, "node")
    roots = components(materialise(stray_links(strays, percent, block, likely), "stray-links"), roots)
    by_class = classes.select("set_id", "class_id").join(roots, F.col("class_id") == F.col("node"), "left").select(
        "set_id", "class_id", F.coalesce("root", "class_id").alias("root"))
    done = signed.select("node", "n_shingles", "set_id").join(by_class, "set_id", "left")
    component = F.coalesce("root", "node")
    return done.select(
        F.col("node").alias(key), "n_shingles", F.when(F.col("node").isNotNull(), component).alias("component_id"),
        F.coalesce(component == F.col("node"), F.lit(True)).alias("kept"),
        F.when(F.col("node").isNotNull(), F.coalesce("class_id", "node")).alias("class_id"))
