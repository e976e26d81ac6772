"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps.

Vectors are whole numbers; scores are inner products.

1. Rows are ordered by label, number of components and place on a Hilbert curve through the directions of their vectors, and
   written as Parquet blocks of one label: each row of the table is a block, with the least and largest value of every
   component (its zone) in columns of their own, which are read without the vectors.
2. Interval arithmetic on a zone bounds the scores that an anchor can have in the block.  An anchor reads a block only if
   this interval meets one of its windows (a range of scores of which the first k are wanted) where it still matters.
3. A search runs in two rounds.  The first reads, of each anchor, the block with the largest upper bound in each window;
   the k-th row found there is a safe end of the window, by score and then by key.  The second reads all blocks whose
   intervals meet what is left of a window, and sends only rows that do.
4. Positives are a search of the anchor's own label with an open window; negatives are one of the other labels with a window
   per positive.

Anchors are dealt into groups and zones into sheets of bounded size; a task scores one group against one block as a matrix
product, in slices.  Blocks have a bounded number of rows, whatever a label's or a vector's share of the table.

Defined results: rows with a null label, a null vector, null or non-finite components or a null key take no part; of rows
with equal keys the one with the smallest (label, vector) counts; vectors of different lengths do not meet; an empty
vector scores 0; a window without room (a positive with a negative score) has no negatives; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import top_k
from ..storage import materialise
from .topk import SCALE, whole

BLOCK_ROWS = 2048
#: Anchors in one group, zones in one sheet, and scores that a task holds at a time.
GROUP_ANCHORS = 2048
SHEET_ZONES = 2048
SLICE_SCORES = 2_000_000
#: Rows of one range of the Hilbert order: a task writes it as blocks.
RANGE_ROWS = 16_384
#: Bits of each component's place on the curve.
CURVE_BITS = 4
LOW, HIGH = -(1 << 62), 1 << 62


# --- blocks --------------------------------------------------------------------------------------------------

def curve_places(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of points (one column each) of whole numbers below 2^bits, as bytes that sort like them.

    Skilling's transformation, for all points at once.
    """
    x = cells.astype(np.uint32)
    d, n = x.shape
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = np.uint32(q - 1)
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint32)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[d - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
    x ^= turn
    # The highest bit of every dimension comes first.
    planes = np.stack([(x >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1)])
    return [row.tobytes() for row in np.packbits(planes.reshape(bits * d, n).T.astype(np.uint8), axis=1)]


def hilbert_keys(matrix: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """Places of the rows' directions on a Hilbert curve through all of their dimensions.

    Components are divided by the row's norm and scaled so that two standard deviations of a random direction fill the
    curve's cube.
    """
    n, d = matrix.shape
    if not n or not d:
        return [b""] * n
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = matrix / np.where(norms == 0, 1.0, norms) * d ** 0.5
    return curve_places(np.clip((unit + 2) / 4 * (1 << bits), 0, (1 << bits) - 1).astype(np.uint32).T, bits)


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in values])


def usable(vectors: DataFrame, key: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(key, label, v) of the rows that take part, one per key."""
    rows = vectors.where(F.col(label).isNotNull()).select(
        F.col(key).alias("_key"), F.col(vector).alias("_vector"), F.col(label).cast("long").alias("label"))
    numbers = F.transform("_vector", lambda x: x.cast("double"))
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = rows.where(F.col("_key").isNotNull() & F.col("_vector").isNotNull() & fine).select(
        F.col("_key").cast("long").alias("key"), "label",
        F.transform(numbers, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    return held.groupBy("key").agg(F.min(F.struct("label", "v")).alias("r")).select("key", "r.label", "r.v")


def write_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The Parquet table of blocks (block, label, dims, n, low, high, keys, vectors), in Hilbert order."""
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths = frame["v"].map(len).to_numpy()
            codes = np.empty(len(frame), object)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                codes[at] = hilbert_keys(_matrix(frame["v"].iloc[at]).astype(np.float64))
            yield frame.assign(dims=lengths.astype(np.int64), place=codes)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, held, size, kind = TaskContext.get().partitionId(), 0, [], 0, None

        def close() -> pd.DataFrame:
            nonlocal made
            frame = pd.concat(held)
            m = _matrix(frame["v"])
            made += 1
            return pd.DataFrame([((part << 32) + made - 1, kind[0], kind[1], len(frame), m.min(axis=0), m.max(axis=0),
                                  frame["key"].to_numpy("<i8").tobytes(), m.astype("<i8").tobytes())],
                                columns=["block", "label", "dims", "n", "low", "high", "keys", "vectors"])

        for frame in frames:
            for now, some in frame.groupby(["label", "dims"], sort=False):
                while len(some):
                    if held and (now != kind or size >= block_rows):
                        yield close()
                        held, size = [], 0
                    take = some.iloc[:block_rows - size]
                    held.append(take)
                    size, kind, some = size + len(take), now, some.iloc[len(take):]
        if held:
            yield close()

    placed = materialise(rows.mapInPandas(place, "key long, label long, v array<bigint>, dims long, place binary"), "placed")
    ranges = 1 + placed.count() // range_rows
    order = ["label", "dims", "place", "key"]
    dealt = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("key", "label", "dims", "v")
    return materialise(dealt.mapInPandas(
        cut, "block long, label long, dims long, n long, low array<bigint>, high array<bigint>, keys binary, vectors binary"),
        "hilbert-blocks")


# --- bounds --------------------------------------------------------------------------------------------------

def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of every anchor with any vector inside every zone.

    Floating point is exact here while sums of products stay below 2^53.
    """
    up, down = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
    low, high = low.astype(np.float64).T, high.astype(np.float64).T
    return up @ low + down @ high, up @ high + down @ low


def _groups(asked: DataFrame, group_anchors: int) -> DataFrame:
    """(group, dims, keys, labels, vectors, windows): anchors packed into rows of bounded size."""
    n = asked.count()
    dealt = asked.withColumn("dims", F.size("v")).withColumn("group", F.pmod(
        F.xxhash64("key"), F.lit(1 + n // group_anchors)))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        return pd.DataFrame([(int(frame["group"].iat[0]), int(frame["dims"].iat[0]), frame["key"].to_numpy("<i8").tobytes(),
                              frame["label"].to_numpy("<i8").tobytes(), _matrix(frame["v"]).astype("<i8").tobytes(),
                              *([list(map(int, w)) for w in frame[c]] for c in ("least", "most", "last")))],
                            columns=["group", "dims", "keys", "labels", "vectors", "least", "most", "last"])

    return dealt.groupBy("group", "dims").applyInPandas(
        pack, "group long, dims long, keys binary, labels binary, vectors binary, "
              "least array<array<bigint>>, most array<array<bigint>>, last array<array<bigint>>")


def _windows(row) -> tuple[np.ndarray, ...]:
    """Of a group: keys, labels, vectors, and the windows' ends and last keys, padded with windows without room."""
    keys, labels = np.frombuffer(row.keys, "<i8"), np.frombuffer(row.labels, "<i8")
    vectors = np.frombuffer(row.vectors, "<i8").reshape(len(keys), -1)
    width = max([len(w) for w in row.least], default=0)
    least, most = np.full((len(keys), width), HIGH), np.full((len(keys), width), LOW)
    last = np.full((len(keys), width), LOW)
    for i, (a, b, c) in enumerate(zip(row.least, row.most, row.last)):
        least[i, :len(a)], most[i, :len(b)], last[i, :len(c)] = a, b, c
    return keys, labels, vectors, least, most, last


def _blocks_to_read(groups: DataFrame, blocks: DataFrame, same_label: bool, best_only: bool, sheet_zones: int) -> DataFrame:
    """(group, dims, block, anchors): the blocks that anchors of a group must read, and which anchors those are.

    Zones meet groups sheet by sheet.  With `best_only` each sheet names the one block of the largest upper bound per window.
    """
    zones = blocks.select("block", "label", "dims", "low", "high")
    sheets = 1 + zones.count() // sheet_zones
    dealt = zones.withColumn("sheet", F.pmod(F.xxhash64("block"), F.lit(sheets))).groupBy("sheet", "dims").agg(
        F.collect_list(F.struct("block", "label", "low", "high")).alias("zones"))
    met = groups.withColumn("sheet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sheets - 1).cast("long")))).join(
        dealt, ["sheet", "dims"])

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                keys, labels, vectors, least, most, _ = _windows(row)
                names = np.array([z["block"] for z in row.zones], np.int64)
                marks = np.array([z["label"] for z in row.zones], np.int64)
                low, high = _matrix([z["low"] for z in row.zones]), _matrix([z["high"] for z in row.zones])
                step = max(1, SLICE_SCORES // max(1, len(names)))
                hit = np.zeros((len(keys), len(names)), bool)
                for a in range(0, len(keys), step):
                    at = slice(a, a + step)
                    lo, hi = score_bounds(vectors[at], low, high)
                    allowed = (labels[at, None] == marks[None]) == same_label
                    for w in range(least.shape[1]):
                        meets = allowed & (hi >= least[at, w, None]) & (lo <= most[at, w, None])
                        if best_only:
                            top = np.where(meets, hi, -np.inf)
                            first = top.argmax(axis=1)
                            some = np.flatnonzero(meets.any(axis=1))
                            hit[a + some, first[some]] = True
                        else:
                            hit[at] |= meets
                out = [(row.group, row.dims, int(names[j]), np.flatnonzero(hit[:, j]).astype("<i4").tobytes())
                       for j in np.flatnonzero(hit.any(axis=0))]
                yield pd.DataFrame(out, columns=["group", "dims", "block", "anchors"]).astype(
                    {"group": "int64", "dims": "int64", "block": "int64"})

    return met.mapInPandas(choose, "group long, dims long, block long, anchors binary")


# --- search --------------------------------------------------------------------------------------------------

def _read(groups: DataFrame, blocks: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(anchor, window, key, score): the first k rows of each block in each window of the anchors that read it."""
    met = chosen.join(groups, ["group", "dims"]).join(
        blocks.select("block", F.col("keys").alias("block_keys"), F.col("vectors").alias("block_vectors")), "block")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                keys, _, vectors, least, most, last = _windows(row)
                mine = np.frombuffer(row.anchors, "<i4")
                names = np.frombuffer(row.block_keys, "<i8")
                others = np.frombuffer(row.block_vectors, "<i8").reshape(len(names), -1).astype(np.float64)
                by_key = np.argsort(names, kind="stable")  # ties go by key
                names, others = names[by_key], others[by_key]
                step = max(1, SLICE_SCORES // len(names))
                parts = [np.empty((4, 0), np.int64)]
                for a in range(0, len(mine), step):
                    at = mine[a:a + step]
                    scores = (vectors[at].astype(np.float64) @ others.T).astype(np.int64)
                    own = keys[at][:, None] == names[None]
                    for w in range(least.shape[1]):
                        inside = (scores >= least[at, w, None]) & (scores <= most[at, w, None]) & ~own
                        inside &= (scores > least[at, w, None]) | (names[None] <= last[at, w, None])
                        i, j = np.nonzero(inside)
                        value = scores[i, j]
                        order = np.lexsort((j, -value, i))
                        i, j, value = i[order], j[order], value[order]
                        first = np.arange(len(i)) - np.searchsorted(i, i) < k
                        i, j = i[first], j[first]
                        parts.append(np.stack([keys[at[i]], np.full(len(i), w), names[j], value[first]]))
                yield pd.DataFrame(np.concatenate(parts, axis=1).T, columns=["anchor", "window", "key", "score"])

    return met.select("group", "dims", "anchors", "keys", "labels", "vectors", "least", "most", "last", "block_keys",
                      "block_vectors").mapInPandas(score, "anchor long, window long, key long, score long").withColumn(
        "window", F.col("window").cast("int"))


def search_windows(asked: DataFrame, blocks: DataFrame, k: int, same_label: bool, group_anchors: int = GROUP_ANCHORS,
                   sheet_zones: int = SHEET_ZONES) -> DataFrame:
    """(anchor, window, rank, key, score): the first k rows in each window of each anchor, by score and then key.

    `asked` is (key, label, v, least, most); window `i` holds the scores from least[i] to most[i].  Rows come from the
    anchor's label if `same_label`, else from all others; an anchor is no answer to itself.
    """
    asked = materialise(asked.withColumn("last", F.transform("least", lambda x: F.lit(HIGH))), "anchors")
    order = [F.col("score").desc(), F.col("key")]
    groups = materialise(_groups(asked, group_anchors), "anchor-groups")
    first = materialise(_blocks_to_read(groups, blocks, same_label, True, sheet_zones), "first-blocks")
    seen = materialise(top_k(_read(groups, blocks, first, k), ["anchor", "window"], order, k), "first-found")
    # k rows up to this one are known: the window need not reach lower, nor, among equal scores, to larger keys.
    kth = F.max(F.struct((-F.col("score")).alias("minus"), "key"))
    ends = seen.groupBy("anchor", "window").agg(F.count("*").alias("n"), kth.alias("kth")).where(F.col("n") >= k).groupBy(
        F.col("anchor").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("ends"))

    def end(i, field: str):
        return F.try_element_at(F.coalesce("ends", F.create_map().cast(ends.schema["ends"].dataType)), i)[field]

    narrowed = asked.join(ends, "key", "left").withColumns({
        "least": F.transform("least", lambda x, i: F.coalesce(-end(i, "minus"), x)),
        "last": F.transform("last", lambda x, i: F.coalesce(end(i, "key"), x))}).drop("ends")
    groups = materialise(_groups(narrowed, group_anchors), "narrow-groups")
    rest = materialise(_blocks_to_read(groups, blocks, same_label, False, sheet_zones), "further-blocks")
    return top_k(_read(groups, blocks, rest, k), ["anchor", "window"], order, k, rank="rank")


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
    key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE,
    block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS, group_anchors: int = GROUP_ANCHORS,
    sheet_zones: int = SHEET_ZONES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows of `vectors` whose key is in `anchors`.  An anchor's positives are its first `positives` other rows
    of its label; the negatives of each are the first rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score.
    """
    rows = materialise(usable(vectors, key, label, vector, scale), "mined-rows")
    asked = rows.join(anchors.select(F.col(key).cast("long").alias("key")).distinct(), "key", "left_semi")
    asked = materialise(asked, "mined-anchors")
    if asked.isEmpty():
        return vectors.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = write_blocks(rows, block_rows, range_rows)
    limits = {"group_anchors": group_anchors, "sheet_zones": sheet_zones}
    whole_line = asked.withColumn("least", F.array(F.lit(LOW))).withColumn("most", F.array(F.lit(HIGH)))
    near = materialise(search_windows(whole_line, blocks, positives, True, **limits).select(
        "anchor", (F.col("rank") - 1).alias("window"), F.col("key").alias("positive_id"),
        F.col("score").alias("positive_score")), "positives")
    # The windows' ends in whole numbers: the least and largest score that satisfy the two conditions.
    listed = near.groupBy(F.col("anchor").alias("key")).agg(F.array_sort(F.collect_list(
        F.struct("window", "positive_score"))).alias("list"))
    ends = listed.select(
        "key", F.transform("list", lambda p: _ceil_div(p["positive_score"] * least)).alias("least"),
        F.transform("list", lambda p: _floor_div(p["positive_score"] * most)).alias("most"))
    found = search_windows(asked.join(ends, "key"), blocks, negatives, False, **limits)
    return found.join(near, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floor_div(x):
    """x div 100, rounded down, in whole numbers."""
    return ((x - F.pmod(x, F.lit(100))) / F.lit(100)).cast("long")


def _ceil_div(x):
    return -_floor_div(-x)
