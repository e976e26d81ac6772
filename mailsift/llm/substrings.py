"""Exact substring dedup over words, with fixed-block anchors.

Reference side: each document is cut into non-overlapping blocks of `anchor` words, which are indexed.  Probe side: every
rolling window of `anchor` words of every document looks the index up.  With `2 * anchor - 1 <= window`, each run of
`window` words holds a whole reference block, so a repeat that is long enough always has a hit.  Around the hits the
windows of `window` words are compared exactly (96 bits of hash each), and the union of the windows that a smaller key
has too is what maximal exact repeats cover.

Anchors and windows go to parts as packed arrays without copies inside a block of documents (see `batches`), so a passage
in very many documents is a few values per block of documents, and no pairs of documents are ever made.

Defined results: words are runs of `[^\\x20\\x09-\\x0D]`; null and empty texts have none; rows with a null key are kept
whole and dedupe nothing; rows with equal keys dedupe nothing of each other (neither key is smaller); an empty table
gives no rows; texts of fewer words than a window lose none.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import batches, words

WINDOW = 13
ANCHOR = 7
#: A second, independent hash for the comparison of windows.
SECOND = 0xD6E8FEB86659FD93


def _numbered(row) -> np.ndarray:
    """Whether each text of a block takes part."""
    return np.array([k is not None for k in row["keys"]], bool)


def _anchors(row, anchor: int):
    """Distinct rolling `anchor`-word keys of a block; marked where a reference block has them."""
    found = words.Texts(batches.texts_of(row))
    keys = words.window_hashes(found.hashes, anchor)
    whole = words.same_owner(found.owner, anchor)
    if len(keys):
        whole &= _numbered(row)[found.owner[:len(keys)]]
    at = np.flatnonzero(whole)
    own = found.owner[at]
    block_start = (at - found.bounds[own]) % anchor == 0
    names, flags, place = batches.distinct_keys(keys[at], own, block_start)
    return found, at, names, flags, place


def _candidates(row, window: int, anchor: int, parts: int):
    """The words of a block and the starts of the windows that hold a shared anchor, with two hashes each."""
    found, at, names, _, place = _anchors(row, anchor)
    hit = np.zeros(len(found.hashes) + window + 1, np.int64)
    hit[at + 1] = batches.read_bits(names, row["bits"], parts)[place]
    hits_before = np.cumsum(hit)
    n = max(len(found.hashes) - window + 1, 0)
    reach = window - anchor + 1
    live = words.same_owner(found.owner, window) & (hits_before[reach:reach + n] > hits_before[:n])
    starts = np.flatnonzero(live)
    first, second = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for k in range(window):
        h = found.hashes[starts + k]
        first = first * np.uint64(0x9E3779B97F4A7C15) + h
        second = second * np.uint64(SECOND) + (h ^ np.uint64(SECOND))
    return found, starts, words.mix(first), (words.mix(second) >> np.uint64(32)).astype("<u4")


def _distinct_windows(row, window: int, anchor: int, parts: int):
    """Per distinct window of a block: both hashes and the smallest key that starts it; and each start's place there."""
    found, starts, first, second = _candidates(row, window, anchor, parts)
    order = np.lexsort((second, first))
    f, s = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    keys = np.array([0 if k is None else int(k) for k in row["keys"]], np.int64)
    smallest = np.minimum.reduceat(keys[found.owner[starts[order]]], np.flatnonzero(new)) if len(order) else keys[:0]
    return found, starts, place, f[new], s[new], smallest, keys


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
    keep_text: bool = True,
) -> DataFrame:
    """Per row: (key, n_words, n_removed, kept_sha256, kept_text).

    A word is removed if a window of `window` words that covers it starts in a document with a smaller key, too; windows
    are judged on the input.  Kept words are joined by one space.  The key must be a whole number.
    """
    if 2 * anchor - 1 > window:
        raise ValueError("a window must hold a whole reference block: 2 * anchor - 1 <= window")
    kind = docs.schema[key].dataType.simpleString()
    table = batches.blocks(docs.select(F.col(key).cast("long").alias(key), text), key, text)
    parts = batches.parts_of(table, 0.2)
    hit = batches.shared(table, lambda row: _anchors(row, anchor)[2:4], parts, need_mark=True)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                _, _, _, first, second, smallest, _ = _distinct_windows(row, window, anchor, parts)
                order, numbers, starts = batches.split_parts(first, parts)
                sent = {"first": first[order], "second": second[order], "key": smallest[order]}
                yield pd.DataFrame({"part": numbers, "block": row["block"]} | {
                    name: [batches.planes(v[a:b]) for a, b in zip(starts[:-1], starts[1:])] for name, v in sent.items()})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        own = [batches.from_planes(k, "<i8") for k in frame["key"]]
        first = np.concatenate([batches.from_planes(v, "<u8") for v in frame["first"]])
        second = np.concatenate([batches.from_planes(v, "<u4") for v in frame["second"]])
        order = np.lexsort((second, first))
        f, s = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        starts = np.flatnonzero(new)
        smallest = np.minimum.reduceat(np.concatenate(own)[order], starts)
        least = np.empty(len(order), np.int64)
        least[order] = smallest[np.cumsum(new) - 1]
        ends = np.cumsum([len(k) for k in own])
        # Only windows with a smaller key elsewhere need an answer; for the others the block's own smallest holds.
        out = []
        for answer, sent in zip(np.split(least, ends[:-1]), own):
            at = np.flatnonzero(answer < sent)
            out.append((at.astype("<u4").tobytes(), answer[at].astype("<i8").tobytes()))
        return pd.DataFrame({"block": frame["block"], "part": frame["part"],
                             "at": [a for a, _ in out], "keys": [k for _, k in out]})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                found, starts, place, first, _, smallest, keys = _distinct_windows(row, window, anchor, parts)
                least = smallest.copy()
                order, numbers, cuts = batches.split_parts(first, parts)
                from_part = {a["part"]: a for a in (row["answers"] if row["answers"] is not None else [])}
                for number, begin in zip(numbers.tolist(), cuts[:-1]):
                    if number in from_part:
                        at = np.frombuffer(from_part[number]["at"], "<u4").astype(np.int64)
                        least[order[begin + at]] = np.frombuffer(from_part[number]["keys"], "<i8")
                repeated = starts[least[place] < keys[found.owner[starts]]] if len(starts) else starts
                change = np.zeros(len(found.hashes) + 1, np.int64)
                np.add.at(change, repeated, 1)
                np.add.at(change, repeated + window, -1)
                keep = np.cumsum(change[:-1]) == 0
                rows = []
                for i, (k, t) in enumerate(zip(row["keys"], batches.texts_of(row))):
                    a, b = found.bounds[i], found.bounds[i + 1]
                    own = t.split() if t else []
                    left = own if keep[a:b].all() else [w for w, y in zip(own, keep[a:b].tolist()) if y]
                    kept = b" ".join(left)
                    rows.append((k, len(own), len(own) - len(left),
                                 hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None))
                yield pd.DataFrame(rows, columns=["key", "n_words", "n_removed", "kept_sha256", "kept_text"])

    met = (hit.drop("n_bytes").mapInPandas(send, "part long, block long, first binary, second binary, key binary")
           .groupBy("part").applyInPandas(meet, "block long, part long, at binary, keys binary")
           .where(F.length("at") > 0))
    answers = met.groupBy("block").agg(F.collect_list(F.struct("part", "at", "keys")).alias("answers"))
    done = hit.drop("n_bytes").join(answers, "block", "left").mapInPandas(
        cut, "key string, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return done.select(F.col("key").cast(kind).alias(key), "n_words", "n_removed", "kept_sha256",
                       *(["kept_text"] if keep_text else []))
