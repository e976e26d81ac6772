"""Packing of tokenised documents into sequences of bounded length.

Documents are cut at multiples of the sequence length.  The pieces are dealt into randomised groups by a hash of the
document, and each group is packed by first-fit decreasing: a tournament tree over the bins' free room finds the first bin
that a piece fits into in logarithmic time.

Text is tokenised in the tasks.  Equal word parts of a batch are tokenised once: a byte-pair vocabulary with word ends
treats runs of letters and runs of other signs on their own, so the ids of a text are those of its parts in order.

Defined results: a null or empty text is the end id alone; rows with equal keys are packed each on its own; a null key is
a key like any other; an empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import words

LENGTH = 4096
#: Documents in a group, about.
GROUP_DOCS = 4096
#: Parts of words whose ids a worker keeps between batches.
CACHE = 1_500_000


class WordParts:
    """Token ids of texts by way of their distinct parts.

    A part is a run of signs without blanks, cut once more where an ASCII letter meets ASCII punctuation other than an
    apostrophe: the vocabulary's pattern never joins the two.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = False
        self.clear()

    def clear(self) -> None:
        self.names = np.empty(0, np.uint64)
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    @staticmethod
    def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letter = ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
        sign = ((data >= 33) & (data <= 47) & (data != 39)) | ((data >= 58) & (data <= 64)) | (
            (data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126))
        # "<|...|>" may be a special token and stays whole
        special = (data == 60) | (data == 62) | (data == 124)
        sign &= ~special
        starts, ends = words.spans(data)
        inner = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])) + 1 if len(data) else starts[:0]
        return np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))

    def _learn(self, names: np.ndarray, parts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        counts = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.uint32)
        if len(self.names) + len(names) > CACHE:
            self.clear()
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) + len(self.ids) if len(counts) else counts
        every = np.concatenate([self.names, names])
        order = np.argsort(every, kind="stable")
        self.names = every[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order and the bounds of each text's ids."""
        encoded = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b" ".join(encoded), np.uint8)
        if not any(b"<|" in e for e in encoded):  # special tokens are found before the vocabulary lowers letters
            data = words.lower_ascii(data)
        starts, ends = self.cuts(data)
        limits = np.cumsum([len(e) + 1 for e in encoded])
        per_text = np.diff(np.searchsorted(starts, limits), prepend=0)
        names, first, place = np.unique(
            words.span_hashes(words.running(data), starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == names[inside]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.names) + len(new) > CACHE:  # the cache starts anew with this batch
                self.clear()
                new = np.arange(len(names))
            raw = data.tobytes()
            self._learn(names[new], [raw[a:b].decode("utf-8", "replace")
                                     for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.names, names)
        counts = self.counts[at][place]
        begin = self.starts[at][place]
        ends_ = np.cumsum(counts)
        total = int(ends_[-1]) if len(ends_) else 0
        gather = np.arange(total) + np.repeat(begin - (ends_ - counts), counts)
        upto = np.concatenate([[0], ends_])[np.concatenate([[0], np.cumsum(per_text)])]
        return self.ids[gather], upto


def _encoder(vocabulary: str) -> WordParts:
    """The encoder of this worker process; it outlives single tasks."""
    held = sys.modules.setdefault("mailsift_llm_held", types.ModuleType("mailsift_llm_held"))
    if getattr(held, "vocabulary", None) != vocabulary:
        held.vocabulary, held.encoder = vocabulary, WordParts(vocabulary)
    return held.encoder


def pieces(
    docs: DataFrame, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    with_ids: bool = False,
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens[, ids]): the pieces of every row's ids, `end_id` last.

    Long documents are cut at multiples of `length`.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary)
        for frame in frames:
            at = 0
            texts = ["" if t is None else t for t in frame["_text"].tolist()]
            keys = frame["_key"].tolist()
            while at < len(texts):
                size, upto = 0, at
                while upto < len(texts) and (upto == at or size < words.CHUNK):
                    size += len(texts[upto])
                    upto += 1
                ids, bounds = encoder.encode(texts[at:upto])
                out = []
                for k, a, b in zip(keys[at:upto], bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), length):
                        part = own[s:s + length]
                        out.append((k, s, len(part), zlib.crc32(part.tobytes()), len(own),
                                    part.astype(np.int64) if with_ids else None))
                yield pd.DataFrame(out, columns=["key", "start", "length", "ids_crc32", "doc_tokens", "ids"])
                at = upto

    rows = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    found = rows.mapInPandas(cut, "key string, start long, length long, ids_crc32 long, doc_tokens long, ids array<bigint>")
    return found.select(F.col("key").cast(kind).alias(key), "start", "length", "ids_crc32", "doc_tokens",
                        *(["ids"] if with_ids else []))


class Tournament:
    """Free room of bins; the winner of each match is the larger room, so the first bin that fits is found top down."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.best = [room] * (2 * self.leaves)

    def first(self, size: int) -> int:
        node = 1
        while node < self.leaves:
            node *= 2
            if self.best[node] < size:
                node += 1
        return node - self.leaves

    def take(self, bin_: int, size: int) -> int:
        """Takes room and tells how much was used before."""
        node = bin_ + self.leaves
        before = self.best[node]
        self.best[node] -= size
        while node > 1:
            node //= 2
            self.best[node] = max(self.best[2 * node], self.best[2 * node + 1])
        return before


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each of the sizes, which come in falling order."""
    tree = Tournament(len(sizes), room)
    bins, offsets = [], []
    for size in sizes:
        bin_ = tree.first(size)
        offsets.append(room - tree.take(bin_, size))
        bins.append(bin_)
    return bins, offsets


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    group_docs: int = GROUP_DOCS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Pieces of a full sequence are sequences on their own; the others are packed within groups of about `group_docs`
    documents.  Offsets of a sequence are without gaps from 0.
    """
    columns = [key, "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else [])
    groups = max(1, round(docs.count() / group_docs))
    # The group depends on the row's content too, so that rows with one key are dealt out.
    dealt = pieces(docs, vocabulary, end_id, key, text, length, with_ids).withColumn(
        "group", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(groups)))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", key, "start", "ids_crc32"], ascending=[False, True, True, True],
                                  kind="stable")
        bins, offsets = first_fit_decreasing(frame["length"].tolist(), length)
        return frame.assign(sequence_id=frame["group"] * (1 << 32) + np.array(bins, np.int64),
                            offset=np.array(offsets, np.int64))[[*columns, "sequence_id", "offset"]]

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(fill, schema)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the padded sequences of pieces that hold their ids.  A power of two is not padded."""
    joined = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda p: p["ids"]))
    power = F.col("ids").isNotNull() & (F.pow(F.lit(2), F.round(F.log2(F.size("ids")))) == F.size("ids"))
    pad = F.array_repeat(F.lit(pad_id).cast("long"), F.lit(length) - F.size("ids"))
    return joined.select("sequence_id", ids.alias("ids")).select(
        "sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", pad)).alias("ids"))
