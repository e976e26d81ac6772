"""Fuzzy line dedup: MinHash over character shingles, exact Jaccard checks, distributed union-find.

1. Each line becomes the set of the hashes of its shingles of `size` code points.  Equal lines are one class.
2. One hash per shingle fills `samples` bins with their minima; empty bins borrow from a full one, found by drawn
   places (one-permutation MinHash).  With 24 bands of 4 bins, two lines at a similarity of 0.8 miss each other
   with a chance of about 3e-6; of 8,328 made-up pairs of lines of 5 to 150 letters at 0.80 to 0.88, with shingles of 5, none
   did.
3. Each block sends the bands of its distinct lines, with 32 bits of the line's name, to the parts that bands belong to; bands
   that lines of two names have come back.  Only lines with such a band are sent, once per block.  Two lines with the same
   32 bits of name (a chance of 2e-10 for a pair) do not find each other by their bands.
4. In each band's bucket members are compared with the bucket's leader, another one in each band, on whole sets.  Members
   of one cluster (lines that hang together at `CLUSTER_PERCENT`) that are left in different components are compared with
   each other in blocks.  A member of a bucket that is in another cluster than its leader (a stray) is compared with all
   members of the bucket.  So every pair of lines that share a band is linked, in one component, or compared.  Links give
   components by union-find.
5. One line of each component stays: the first in order of (document key, hash of the document's text, place).

Sets are compared by 54 bits of hash for each shingle.

Lines are cut at `\\n`.  Defined results: null and empty texts stay as they are; empty and blank lines are never removed;
lines shorter than a shingle are equal or not alike; a document may lose all of its lines and is then an empty text; rows
with a null key are kept whole and take no part; of rows with equal keys the one whose text has the smaller hash is the
earlier, and of equal rows any one; an empty table gives no rows; all other columns pass through as they are, and one that
is named like a new column is called `input_` and its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.joins import join_small
from ..storage import materialise
from . import batches, words
from .components import between, components
from .spanning import open_clusters, spanning_links, stray_links

#: With shorter shingles lines meet by chance: of the 404,191 lines of check_s 242,738 share a band with another one at 5 code
#: points, 73,434 at 6, 43,223 at 7 and 40,178 at 8.  One changed letter inside a line is seen through from 79 letters on
#: (6: 59, 5: 49), at its ends from 16 on.
SIZE = 8
PERCENT = 80
#: Lines from this similarity on belong to one cluster.
CLUSTER_PERCENT = 50
BANDS, ROWS = 24, 4
#: Members of a cluster that are compared with each other in one task.
BLOCK = 512
#: Buckets with strays and up to so many members are compared pair by pair, larger ones in blocks.
SMALL_BUCKET = 32
#: Text in one block; its shingles are arrays of eight bytes for each byte of it.
BLOCK_BYTES = 1 << 19
#: Text whose bands are made at a time: the arrays for it stay near the processor.
SLICE_BYTES = 1 << 16
#: Lines whose sets are sorted at a time; their number goes into the upper bits of a shingle's hash.
OWNER_BITS = 10
EMPTY = np.uint32(0xFFFFFFFF)
#: Bins that an empty one looks into before it takes the next full one.
PROBES = 16


class Lines:
    """The lines of a block that take part: (document, place, start, end) in the joined bytes, each text with a last `\\n`."""

    def __init__(self, row):
        texts = batches.texts_of(row)
        self.data = np.frombuffer(b"".join((t or b"") + b"\n" for t in texts), np.uint8)
        ends = np.flatnonzero(self.data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        text_start = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
        doc = np.searchsorted(text_start, starts, side="right") - 1
        place = np.arange(len(starts)) - np.searchsorted(starts, text_start[:-1])[doc]
        # most lines begin with ink
        ink = ~words.blanks(self.data[starts])
        for k in np.flatnonzero(~ink & (ends > starts)).tolist():
            ink[k] = not words.blanks(self.data[starts[k]:ends[k]]).all()
        use = ink & np.array([k is not None for k in row["keys"]], bool)[doc]
        self.doc, self.place, self.starts, self.ends = doc[use], place[use], starts[use], ends[use]
        self.text_start = text_start

    @cached_property
    def sums(self) -> np.ndarray:
        return words.running(self.data)

    @cached_property
    def names(self) -> np.ndarray:
        return words.span_hashes(self.sums, self.starts, self.ends)

    @cached_property
    def texts(self) -> np.ndarray:
        """The hash of the whole text of each line's document."""
        return words.span_hashes(self.sums, self.text_start[:-1], self.text_start[1:] - 1)[self.doc]

    def without(self, gone: np.ndarray, known: list[bool]) -> pa.StringArray:
        """All texts without the lines marked in `gone`; null where a text is not known."""
        keep = np.ones(len(self.data), bool)
        for a, b in zip(self.starts[gone].tolist(), self.ends[gone].tolist()):
            keep[a:b + 1] = False
        # of what is left of each text the last byte is its last line's end
        left = np.add.reduceat(keep.view(np.int8), self.text_start[:-1], dtype=np.int64)
        some, ends = left > 0, np.cumsum(left)
        data = self.data[keep]
        keep = np.ones(len(data), bool)
        keep[ends[some] - 1] = False
        raw, ends = data[keep].tobytes(), np.append(0, np.cumsum(left - some))
        try:
            self.data.tobytes().decode("utf-8")
        except UnicodeDecodeError:
            cuts = zip(ends[:-1].tolist(), ends[1:].tolist())
            return pa.array([raw[a:b].decode("utf-8", "replace") if k else None for k, (a, b) in zip(known, cuts)], pa.string())
        return pa.StringArray.from_buffers(
            len(known), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw), pa.py_buffer(np.packbits(known, bitorder="little")))

    def distinct(self):
        """The first place of each distinct line, in order of its name."""
        return np.unique(self.names, return_index=True)

    def bands(self, at: np.ndarray, size: int, bands: int, rows: int) -> np.ndarray:
        """The band hashes of the lines `at`; one row per line."""
        out = np.empty((len(at), bands), np.uint64)
        order = np.argsort(self.starts[at])
        starts, ends = self.starts[at][order], self.ends[at][order]
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(self.data), SLICE_BYTES)), len(at)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            out[order[a:b]] = bands_of(*shingles(self.data, self.sums, starts[a:b], ends[a:b], size), b - a, bands, rows)
        return out


def shingles(data: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int):
    """(number of the line, hash) of all shingles of `size` code points of lines in UTF-8, which are given in text order;
    a short line is one shingle."""
    low, high = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
    wide = data[low:high] >= 0x80
    if wide.any():
        heads = np.append(np.flatnonzero(~wide | (data[low:high] >= 0xC0)), high - low)
        first, last = np.searchsorted(heads, starts - low), np.searchsorted(heads, ends - low)
        every = words.hashes_between(sums, low, heads, size)
    else:
        first, last = starts - low, ends - low
        every = words.rolling_hashes(sums, size, low, high)
    counts = last - first - size + 1
    short = counts < 1
    runs = [every[a:b] for a, b in zip(first.tolist(), (first + np.maximum(counts, 0)).tolist())]
    if short.any():
        counts[short] = 1
        names = words.span_hashes(sums, starts[short], ends[short])
        for k, at in enumerate(np.flatnonzero(short).tolist()):
            runs[at] = names[k:k + 1]
    return np.repeat(np.arange(len(starts)), counts), np.concatenate(runs) if runs else np.empty(0, np.uint64)


def _slices(lengths: np.ndarray, owner_bits: int = OWNER_BITS) -> Iterator[tuple[int, int]]:
    """Ranges of lines that are worked on at a time."""
    total = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        upto = int(np.searchsorted(total, (total[at - 1] if at else 0) + 2 * SLICE_BYTES, side="right"))
        upto = min(max(upto, at + 1), at + (1 << owner_bits))
        yield at, upto
        at = upto


def _hashed(lines: list[bytes], size: int):
    """(number of the line, hash) of all shingles of a slice of lines."""
    ends = np.cumsum(np.array([len(x) for x in lines], np.int64))
    data = np.frombuffer(b"".join(lines), np.uint8)
    return shingles(data, words.running(data), np.append(0, ends[:-1]), ends, size)


def _sorted_sets(lines: list[bytes], size: int) -> np.ndarray:
    """The distinct (number of the line, 54 bits of a shingle's hash) of a slice of lines, packed and in order."""
    return _packed(*_hashed(lines, size))


def _packed(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The distinct (number of the line, 54 bits of a shingle's hash), packed and in order."""
    values = np.sort((owner.astype(np.uint64) << np.uint64(64 - OWNER_BITS)) | (hashes >> np.uint64(OWNER_BITS)))
    return values[np.append(True, values[1:] != values[:-1])]


def _counted(values: np.ndarray, n: int) -> np.ndarray:
    """How many of the packed values each of `n` lines has."""
    return np.bincount((values >> np.uint64(64 - OWNER_BITS)).astype(np.int64), minlength=n)


def line_sets(lines: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of lines in UTF-8."""
    out = []
    for a, b in _slices(np.array([len(x) for x in lines], np.int64)):
        values = _sorted_sets(lines[a:b], size)
        out += np.split(values << np.uint64(OWNER_BITS), np.cumsum(_counted(values, b - a))[:-1])
    return out


def set_sizes(lines: list[bytes], size: int) -> np.ndarray:
    """How many distinct shingles each line has."""
    cuts = _slices(np.array([len(x) for x in lines], np.int64))
    return np.concatenate([_counted(_sorted_sets(lines[a:b], size), b - a) for a, b in cuts])


def percents(left: list[bytes], right: list[bytes], size: int) -> np.ndarray:
    """The exact similarity of each line of `left` with that of `right`, in hundredths, rounded down."""
    out = []
    for a, b in _slices(np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64), OWNER_BITS - 1):
        # lines and their partners are 2 k and 2 k + 1: the side is the last bit, so equal values of a pair are neighbours
        lines = [line for pair in zip(left[a:b], right[a:b]) for line in pair]
        owner, hashes = _hashed(lines, size)
        values = (hashes >> np.uint64(OWNER_BITS)) << np.uint64(1)
        values |= owner.astype(np.uint64) & np.uint64(1)
        values |= (owner >> 1).astype(np.uint64) << np.uint64(65 - OWNER_BITS)
        values.sort()
        values = values[np.append(True, values[1:] != values[:-1])] >> np.uint64(1)
        pair = (values >> np.uint64(64 - OWNER_BITS)).astype(np.int64)
        both = np.bincount(pair[1:][values[1:] == values[:-1]], minlength=b - a)
        out.append(100 * both // (np.bincount(pair, minlength=b - a) - both))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@cache
def _drawn(tried: int, samples: int) -> np.ndarray:
    """The bin that each bin looks into at the given trial."""
    return (words.mix(np.arange(samples, dtype=np.uint64) + np.uint64(1 + tried * samples)) % np.uint64(samples)).astype(np.int64)


def bands_of(owner: np.ndarray, hashes: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """The band hashes of `n` lines; one row per line."""
    samples = bands * rows
    grid = np.full(n * samples, EMPTY, np.uint32)
    bins = hashes >> np.uint64(32)
    bins *= np.uint64(samples)
    bins >>= np.uint64(32)
    at = owner * samples
    at += bins.view(np.int64)
    np.minimum.at(grid, at, hashes.astype(np.uint32))
    # an empty bin takes the sample of the first full one among bins drawn for it
    value, todo = grid.copy(), np.flatnonzero(grid == EMPTY)
    bins = todo % samples
    for tried in range(PROBES):
        if not len(todo):
            break
        seen = grid[todo - bins + _drawn(tried, samples)[bins]]
        value[todo] = seen
        left = np.flatnonzero(seen == EMPTY)
        todo, bins = todo[left], bins[left]
    value = value.reshape(n, samples).astype(np.uint64)
    if len(todo):
        # very few are full: that of the next full one to its right
        which, bins = np.divmod(todo, samples)
        some, at = np.unique(which, return_inverse=True)
        own = grid.reshape(n, samples)[some]
        place = np.where(own != EMPTY, np.arange(samples, dtype=np.int32), np.int32(2 * samples))
        double = np.concatenate([place, place + samples], axis=1)
        next_full = np.minimum.accumulate(double[:, ::-1], axis=1)[:, ::-1][:, :samples] % samples
        value[which, bins] = own[at, next_full[at, bins]]
    out = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        out = out * np.uint64(0xD6E8FEB86659FD93) + value[:, r * bands:(r + 1) * bands]
    return words.mix(out + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _live_bands(table: DataFrame, size: int, bands: int, rows: int, parts: int) -> DataFrame:
    """(block, live array<struct<part, keys, names>>): the bands of each block's lines that another line has, too.

    Each block sends the bands of its distinct lines to the part that a band belongs to: four bytes of the band's hash and four
    of the line's.  The part sends back the bands that lines of two names have, so copies alone keep no band.
    """

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                lines = Lines(row)
                names, at = lines.distinct()
                flat = lines.bands(at, size, bands, rows).ravel()
                order, numbers, starts = batches.split_parts(flat, parts)
                keys = (flat >> np.uint64(32)).astype(np.uint32)[order]
                short = np.repeat(names.astype(np.uint32), bands)[order]
                cuts = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
                yield pd.DataFrame({"part": numbers, "block": row["block"], "keys": [keys[a:b].tobytes() for a, b in cuts],
                                    "names": [short[a:b].tobytes() for a, b in cuts]})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(k, np.uint32) for k in frame["keys"]]
        keys, names = np.concatenate(own), np.frombuffer(b"".join(frame["names"]), np.uint32)
        live = _among(keys, _with_two(keys, names))
        ends = np.cumsum([0, *map(len, own)])
        kept = np.append(0, np.cumsum(live))[ends]
        keys, names, some = keys[live], names[live], np.flatnonzero(np.diff(kept))
        return pd.DataFrame({
            "block": frame["block"].to_numpy()[some], "part": frame["part"].to_numpy()[some],
            "keys": [keys[kept[k]:kept[k + 1]].tobytes() for k in some],
            "names": [names[kept[k]:kept[k + 1]].tobytes() for k in some]})

    sent = table.mapInPandas(send, "part long, block long, keys binary, names binary")
    met = sent.groupBy("part").applyInPandas(meet, "block long, part long, keys binary, names binary")
    return met.groupBy("block").agg(F.collect_list(F.struct("part", "keys", "names")).alias("live"))


def _with_two(keys: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The keys that stand with more than one name, in order."""
    pairs = np.sort((keys.astype(np.uint64) << np.uint64(32)) | names)
    keys = (pairs[np.append(True, pairs[1:] != pairs[:-1])] >> np.uint64(32)).astype(np.uint32)
    again = keys[1:][keys[1:] == keys[:-1]]
    return again[np.append(True, again[1:] != again[:-1])] if len(again) else again


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each key is one of a few, which are in order."""
    out = np.zeros(len(keys), bool)
    if len(some):
        # a look at the last bits leaves few to search for
        seen = np.zeros(1 << 16, bool)
        seen[some & np.uint32(0xFFFF)] = True
        at = np.flatnonzero(seen[keys & np.uint32(0xFFFF)])
        there = np.searchsorted(some, keys[at])
        out[at] = some[np.minimum(there, len(some) - 1)] == keys[at]
    return out


def _line_rows(table: DataFrame) -> DataFrame:
    """(node, buckets array<long>, set binary) of table (..., live): one row per block and distinct line with a shared band.

    `set` is the line itself, an eighth of the size of its shingle hashes.
    """

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in batch.to_pylist():
                lines = Lines(row)
                names, at = lines.distinct()
                buckets = np.concatenate([(np.frombuffer(x["keys"], np.uint32).astype(np.int64)) | (x["part"] << 32)
                                          for x in row["live"]])
                line, which = _places(names.astype(np.uint32), np.frombuffer(b"".join(x["names"] for x in row["live"]), np.uint32))
                order = np.lexsort((buckets[which], line))
                chosen, begin = np.unique(line[order], return_index=True)
                raw = lines.data.tobytes()
                starts, ends = lines.starts[at[chosen]].tolist(), lines.ends[at[chosen]].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[chosen].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)), pa.int32()), pa.array(buckets[which][order])),
                     pa.array([raw[a:b] for a, b in zip(starts, ends)], pa.binary())], names=["node", "buckets", "set"])

    return table.mapInArrow(read, "node long, buckets array<long>, set binary")


def _places(names: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `names`, place in `asked`) of all that are equal."""
    order = np.argsort(names)
    low, high = (np.searchsorted(names[order], asked, side) for side in ("left", "right"))
    which = np.repeat(np.arange(len(asked)), high - low)
    into = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    return order[low[which] + into], which


def _with_sizes(found: DataFrame, size: int) -> DataFrame:
    """(node, n, buckets, set) of lines (node, buckets, set): n is the number of their shingles."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            n = set_sizes(batch.column("set").to_pylist(), size) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(n, pa.int64()), batch.column("buckets"), batch.column("set")],
                names=["node", "n", "buckets", "set"])

    return found.mapInArrow(count, "node long, n long, buckets array<long>, set binary")


def _compared(pairs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """(a, b, percent): the exact similarity of the pairs, rounded down."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"],
                                "percent": percents(frame["set_a"].tolist(), frame["set_b"].tolist(), size)})

    rows = (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b"))
    return rows.select("a", "b", "set_a", "set_b").mapInPandas(compare, "a long, b long, percent long")


def _strays(apart: DataFrame, members: DataFrame, clusters: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, n_shingles, root, stray, strays, n) of the buckets (`apart`: bucket, leader) whose leader is in another
    cluster than one of its members, without the leader; `strays` and `n` count the bucket's strays and rows."""
    of_leader = apart.join(clusters.withColumnsRenamed({"node": "leader", "cluster": "lead"}), "leader", "left").select(
        "bucket", "leader", F.coalesce("lead", "leader").alias("lead"))
    # Few buckets are left apart as a rule: then they travel to the members, which are not shuffled.
    of_leader = materialise(of_leader, "line-apart")
    standing = join_small(members, of_leader, ["bucket"], "node").where("node != leader").join(clusters, "node", "left").join(
        roots, "node", "left").select(
        "bucket", "node", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"),
        (F.coalesce("cluster", "node") != F.col("lead")).alias("stray"))
    standing = materialise(standing, "line-strays")
    split = standing.groupBy("bucket").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"),
        F.count_if("stray").alias("strays")).where("lo != hi and strays > 0")
    return join_small(standing, split.select("bucket", "strays", "n"), ["bucket"], "node")


def _links_of_strays(strays: DataFrame, sets: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) of each stray with the members of its bucket in other components."""
    few = strays.where(F.col("n") <= SMALL_BUCKET)
    one = few.select("bucket", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n_shingles").alias("na"),
                     F.col("stray").alias("sa"))
    two = few.select("bucket", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n_shingles").alias("nb"),
                     F.col("stray").alias("sb"))
    pairs = one.join(two, "bucket").where("a > b and ra != rb and (sa or sb)").where(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct()
    links = _compared(pairs, sets, size).where(F.col("percent") >= percent).select("a", "b")
    many = strays.where(F.col("n") > SMALL_BUCKET).join(sets, "node")
    return links.union(stray_links(many, percent, block, unpack=lambda column: line_sets(column, size)))


def line_components(table: DataFrame, size: int, percent: int, bands: int, rows: int, block: int) -> DataFrame:
    """(node, root) of every line of the blocks that is alike to another one; nodes are line hashes."""
    table = table.select("block", "keys", "lengths", "texts", "n_bytes")
    parts = batches.parts_of(table, 0.1)
    live = _live_bands(table.drop("n_bytes"), size, bands, rows, parts)
    # copies of a line have the same bands
    found = _line_rows(table.drop("n_bytes").join(live, "block")).groupBy("node").agg(
        F.max("buckets").alias("buckets"), F.max("set").alias("set"))
    found = materialise(_with_sizes(found, size), "lines")
    sets = found.select("node", "set")
    members = found.select(F.explode("buckets").alias("bucket"), "node", "n")
    # The order of the nodes differs from bucket to bucket.
    drawn = F.xxhash64("bucket")
    leaders = members.groupBy("bucket").agg(
        F.min(F.col("node").bitwiseXOR(drawn)).alias("least"), F.count("*").alias("rows")).where("rows > 1").select(
        "bucket", F.col("least").bitwiseXOR(drawn).alias("leader"), "rows")
    # A pair shares at most one bucket per band.
    pairs = members.join(leaders, "bucket").where("node != leader").select(
        F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b"), "bucket", "leader", "rows").groupBy(
        "a", "b").agg(
        F.count("*").alias("n"), F.collect_list(F.when(F.col("rows") > 2, F.struct("bucket", "leader"))).alias("buckets"))
    pairs = materialise(pairs, "line-pairs")
    # The partner that shares most bands first, the others only where that left two components.
    first = pairs.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", "m.b")
    compared = materialise(_compared(first, sets, size), "line-links")
    roots = components(compared.where(F.col("percent") >= percent))
    rest = between(pairs.select("a", "b"), roots).select("a", "b").join(first, ["a", "b"], "left_anti")
    compared = materialise(compared.union(_compared(rest, sets, size)), "line-links")
    roots = components(compared.where(F.col("percent") >= percent).select("a", "b"), roots)
    # What the leaders left apart.
    clusters = components(compared.where(F.col("percent") >= CLUSTER_PERCENT).select("a", "b"), roots)
    across = spanning_links(open_clusters(clusters, roots).join(sets, "node"), percent, block,
                            unpack=lambda column: line_sets(column, size))
    apart = between(pairs.where("size(buckets) > 0"), clusters).select(F.inline("buckets")).distinct()
    clusters = clusters.withColumnRenamed("root", "cluster")
    strays = _strays(apart, members, clusters, roots)
    links = across.union(_links_of_strays(strays, sets, size, percent, block))
    return components(materialise(links, "line-across"), roots)


def _kept(table: DataFrame, roots: DataFrame, out: T.StructType) -> DataFrame:
    """`out` (key, text, the extra columns, n_lines, n_removed) of every row, given the components of lines that are alike."""

    def firsts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                lines = Lines(row)
                keys = np.array([0 if k is None else int(k) for k in row["keys"]], np.int64)[lines.doc]
                texts = lines.texts.view(np.int64)
                order = np.lexsort((lines.place, lines.doc, texts, keys))
                names, at = np.unique(lines.names[order], return_index=True)
                at = order[at]
                yield pd.DataFrame({"node": names.view(np.int64), "block": row["block"], "key": keys[at], "whole": texts[at],
                                    "doc": lines.doc[at], "place": lines.place[at]})

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row, stay in zip(batch.drop_columns(["stay"]).to_pylist(), batch.column("stay")):
                lines = Lines(row)
                own = lines.doc * (1 << 32) + lines.place
                gone = np.ones(len(own), bool)
                if stay.is_valid:
                    doc, place = (stay.values.field(x).to_numpy() for x in ("doc", "place"))
                    gone[np.searchsorted(own, doc * (1 << 32) + place)] = False
                n = len(row["keys"])
                texts = lines.without(gone, [k >= 0 for k in np.frombuffer(row["lengths"], "<i8").tolist()])
                more = pa.ipc.open_stream(row["extra"]).read_all().columns if row["extra"] else []
                columns = [pa.array(row["keys"], pa.string()), texts,
                           *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in more],
                           pa.array(np.bincount(lines.doc, minlength=n), pa.int64()),
                           pa.array(np.bincount(lines.doc[gone], minlength=n), pa.int64())]
                yield from pa.Table.from_arrays(columns, names=out.names).to_batches(max_chunksize=1000)

    # One row per block and distinct line, as hashes: the text stays where it is.
    seen = table.select("block", "keys", "lengths", "texts").mapInPandas(
        firsts, "node long, block long, key long, whole long, doc long, place long")
    stay = (seen.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
            .agg(F.min(F.struct("key", "whole", "block", "doc", "place")).alias("m"))
            .groupBy("m.block").agg(F.collect_list(F.struct("m.doc", "m.place")).alias("stay")))
    return table.join(stay, "block", "left").mapInArrow(cut, out)


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT,
    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK,
) -> DataFrame:
    """`docs` with the texts without the lines that an earlier line is alike to, and the new columns n_lines (lines that
    are not blank) and n_removed.

    Lines are alike if they are in one component of links of `percent` or more; equal lines always are.  Keys are whole
    numbers.
    """
    others = [f for f in docs.schema.fields if f.name not in (key, text)]
    carried = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(others)]
    table = batches.blocks(docs, key, text, BLOCK_BYTES, carried)
    roots = materialise(line_components(table, size, percent, bands, rows, block), "line-roots")
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("text", T.StringType()),
                        *[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(others)],
                        T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    kept = _kept(table, roots, out)
    names = {f.name for f in docs.schema.fields}

    def shown(name: str) -> str:
        if name.lower() not in ("n_lines", "n_removed"):
            return name
        name = f"input_{name}"
        while name in names:
            name = f"input_{name}"
        return name

    place = {f.name: i for i, f in enumerate(others)}
    return kept.select([
        F.col("key").cast(f.dataType).alias(shown(f.name)) if f.name == key
        else F.col("text").alias(shown(f.name)) if f.name == text
        else F.col(f"c{place[f.name]}").alias(shown(f.name)) for f in docs.schema.fields] + ["n_lines", "n_removed"])
