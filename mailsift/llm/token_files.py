"""Token ids in binary files of directly addressable codes: any token is read without decoding others.

An id is cut into chunks of 8 bits, lowest first.  Level 1 holds the first chunk of every id and one continuation bit per
id; level 2 holds the second chunks of the ids whose bit is set, with bits of their own, and so on; the last level has no
bits.  The place of an id on the next level is the number of set bits before it, which a rank directory (one count per 512
bits) answers from at most 64 bytes of the bitmap.

A file, all numbers little-endian:

    b"DAC1", levels u32, range u64, place u64, ids u64, documents u64
    keys i64[documents], null marks u8[documents], starts u64[documents + 1]     starts count ids within the file
    per level: chunks u64, bitmap u8 (1 if there is one), chunks u8[chunks], bitmap u8[chunks / 8], ranks u32[chunks / 512 + 1]

Writing: rows of documents are cut into ranges of their keys whose bounds come from a light table without texts, ids are
shuffled once, in compressed form, and each task writes its ranges in order.  Ties of keys are cut by the text's hash and
the row's place too, so one key with a third of all rows makes many ranges.  Files are written by Spark's own sink (a lost
executor's files are written again, uncommitted ones are never seen) and read as binary files, so any store that Spark
reaches will do.

Defined results: null and empty texts are the end id alone; documents come in ascending order of keys, null keys first,
equal keys in order of their texts' hashes, all of them kept; an empty table makes no files and gives no rows.  Other
columns are not looked at.  Keys are whole numbers of up to 64 bits, ids of up to 32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ranking import running_count
from ..storage import materialise, new_path
from .packing import _encoder
from .words import slices

END_ID = 2
#: Characters of text in one range of keys, about, and ids in one file at most (a longer document is a file on its own).
RANGE_CHARS = 24_000_000
FILE_IDS = 1_000_000
#: Ids that a reader decodes at a time, but for a longer document.
DECODED_IDS = 500_000
#: The table of the files' first places, beside the files; a leading underscore hides it from readers of the folder.
STARTS = "_starts"
#: Files that `tokens_at` names one by one; for more it reads the whole folder.
NAMED_FILES = 10_000
MAGIC = b"DAC1"
HEAD = "<4sIQQQQ"
HEAD_BYTES = struct.calcsize(HEAD)
LEVEL = "<QB"
#: Bits that one count of the rank directory covers.
RANK_BITS = 512


# --- the codes -----------------------------------------------------------------------------------------------

def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Per level (chunks, bitmap, rank directory); the last level has chunks only."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while True:
        chunks = rest.astype(np.uint8)  # the lowest eight bits
        more = rest > 255
        if not more.any():
            levels.append((chunks, None, None))
            return levels
        bitmap = np.packbits(more, bitorder="little")
        ends = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32)
        levels.append((chunks, bitmap, np.concatenate([[0], np.cumsum(ends)]).astype("<u4")))
        rest = rest[more] >> np.uint32(8)


def pack_file(range_: int, place: int, keys: list, counts: list[int], ids: np.ndarray) -> bytes:
    """One file's bytes: the ids of consecutive documents."""
    levels = encode(ids)
    null = np.array([k is None for k in keys], np.uint8)
    out = [struct.pack(HEAD, MAGIC, len(levels), range_, place, len(ids), len(keys)),
           np.array([0 if k is None else k for k in keys], "<i8").tobytes(), null.tobytes(),
           np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()]
    for chunks, bitmap, ranks in levels:
        out.append(struct.pack(LEVEL, len(chunks), bitmap is not None))
        out.append(chunks.tobytes())
        if bitmap is not None:
            out += [bitmap.tobytes(), ranks.tobytes()]
    return b"".join(out)


_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class TokenFile:
    """Random access to one file's ids, over any buffer of its bytes (also a memory map)."""

    def __init__(self, data):
        magic, n_levels, self.range, self.place, self.n_ids, self.n_docs = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at = HEAD_BYTES

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, n, at)
            at += part.nbytes
            return part

        self.keys, self.null = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n, mapped = struct.unpack_from(LEVEL, data, at)
            at += struct.calcsize(LEVEL)
            chunks = take("u1", n)
            self.levels.append((chunks, take("u1", -(-n // 8)) if mapped else None,
                                take("<u4", -(-n // RANK_BITS) + 1) if mapped else None))

    def token(self, i: int) -> int:
        """The id at place `i`: one chunk per level, and at most 64 bytes of each bitmap."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            inside = bitmap[block * (RANK_BITS // 8):i >> 3]
            below = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(_BITS[inside].sum()) + int(_BITS[below])
            shift += 8
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from `start` to `stop`: one rank per level, then each level's chunks lie side by side."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError((start, stop))
        out = np.zeros(stop - start, np.uint32)
        at, shift = np.arange(stop - start), 0
        for chunks, bitmap, ranks in self.levels:
            out[at] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            if bitmap is None or start == stop:
                break
            first = start >> 3
            set_ = np.unpackbits(bitmap[first:-(-stop // 8)], bitorder="little")[
                start - 8 * first:stop - 8 * first].astype(bool)
            block = start // RANK_BITS
            inside = bitmap[block * (RANK_BITS // 8):first]
            below = int(bitmap[first]) & ((1 << (start & 7)) - 1)
            start = int(ranks[block]) + int(_BITS[inside].sum()) + int(_BITS[below])
            at = at[set_]
            stop = start + len(at)
            shift += 8
        return out

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))


# --- writing -------------------------------------------------------------------------------------------------

def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hash, row, text): the order of documents is that of the first three, nulls first."""
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"),
                       F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))


def _bounds(rows: DataFrame, range_chars: int) -> list[tuple]:
    """The least (key, hash, row) of every range but the first; as many as there are ranges, whatever the rows."""
    light = rows.select("key", "hash", "row", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"))
    total = light.agg(F.sum("chars").alias("chars"), F.count("*").alias("n")).first()
    if not total["n"]:
        return []
    ranges = 1 + (total["chars"] + total["n"]) // range_chars
    if ranges == 1:
        return [(None, None, None)]
    cut = light.select("key", "hash", "row").repartitionByRange(
        int(ranges), F.col("key").asc_nulls_first(), "hash", "row").groupBy(F.spark_partition_id().alias("part"))
    least = F.struct(F.col("key").isNotNull().alias("known"), F.col("key"), F.col("hash"), F.col("row"))
    return [(r["l"]["key"], r["l"]["hash"], r["l"]["row"])
            for r in cut.agg(F.min(least).alias("l")).orderBy("l").collect()]


def _order(key, hash_, row) -> tuple:
    return (key is not None, key if key is not None else 0, hash_, row)


def write(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text",
    range_chars: int = RANGE_CHARS, file_ids: int = FILE_IDS,
) -> None:
    """Write the ids of all texts, each followed by `end_id`, as files under `path`, in ascending order of keys."""
    rows = _rows(docs, key, text)
    bounds = _bounds(rows, range_chars)[1:]

    def tokenise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_right

        encoder, cuts = _encoder(vocabulary), [_order(*b) for b in bounds]
        small = zstandard.ZstdCompressor(level=1)
        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"].tolist()]
            keys = [None if missing else k for k, missing in zip(frame["key"].tolist(), frame["missing"].tolist())]
            hashes, places = frame["hash"].tolist(), frame["row"].tolist()
            for a, b in slices(texts):
                ids, limits = encoder.encode(texts[a:b])
                wide = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
                yield pd.DataFrame(
                    [(bisect_right(cuts, _order(keys[i], hashes[i], places[i])), keys[i], hashes[i], places[i],
                      int(wide[-1]), small.compress(ids[limits[i - a]:limits[i - a + 1]].astype(wide).tobytes()))
                     for i in range(a, b)], columns=["range", "key", "hash", "row", "width", "ids"]).astype({"key": "Int64"})

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        range_, place, keys, counts, held, n = None, 0, [], [], [], 0
        large = zstandard.ZstdDecompressor()

        def close() -> pd.DataFrame:
            return pd.DataFrame({"value": [pack_file(range_, place, keys, counts, np.concatenate(held))]})

        for frame in frames:
            nulls = frame["key"].isna().tolist()
            for i, (r, k, width, data) in enumerate(zip(frame["range"], frame["key"], frame["width"], frame["ids"])):
                own = np.append(np.frombuffer(large.decompress(data), f"<u{width}").astype(np.uint32), np.uint32(end_id))
                if keys and (r != range_ or n + len(own) > file_ids):
                    yield close()
                    place, keys, counts, held, n = (place + 1 if r == range_ else 0), [], [], [], 0
                elif r != range_:
                    place = 0
                range_ = r
                keys.append(None if nulls[i] else int(k))
                counts.append(len(own))
                held.append(own)
                n += len(own)
        if keys:
            yield close()

    found = rows.withColumn("missing", F.col("key").isNull()).withColumn("key", F.coalesce("key", F.lit(0))).mapInPandas(
        tokenise, "range long, key long, hash long, row long, width int, ids binary")
    order = ["range", F.col("key").asc_nulls_first(), "hash", "row"]
    dealt = found.repartition(len(bounds) + 1, "range").sortWithinPartitions(*order)
    files = dealt.select("range", "key", "width", "ids").mapInPandas(fill, "value binary")
    # The text sink writes bytes as they are and a line end after them, which readers do not look at.
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    _starts(docs.sparkSession, path).write.parquet(f"{path}/{STARTS}")


# --- reading -------------------------------------------------------------------------------------------------

def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > HEAD_BYTES).select("path", "content")


def read_documents(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document, from the files alone.

    `start` counts the ids of all documents before it: those in its file, and a running sum over files.
    """
    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                file = TokenFile(content)
                at = file.starts
                first = 0
                while first < file.n_docs:
                    upto = max(first + 1, int(np.searchsorted(at, at[first] + DECODED_IDS, "right")) - 1)
                    upto = min(upto, file.n_docs)
                    ids = file.tokens(int(at[first]), int(at[upto])).astype("<u4")
                    own = np.split(ids, at[first + 1:upto] - at[first])
                    out = pd.DataFrame({
                        "key": pd.array(file.keys[first:upto], "Int64"), "range": file.range, "place": file.place,
                        "before": at[first:upto], "n_tokens": [len(x) for x in own], "ids_crc32": [zlib.crc32(x) for x in own]})
                    out.loc[file.null[first:upto].astype(bool), "key"] = pd.NA
                    if with_ids:
                        out["ids"] = [x.astype(np.int64) for x in own]
                    yield out
                    first = upto

    tail = ", ids array<bigint>" if with_ids else ""
    docs = _files(spark, path).select("content").mapInPandas(
        decode, f"key long, range long, place long, before long, n_tokens long, ids_crc32 long{tail}")
    starts = spark.read.parquet(f"{path}/{STARTS}").select("range", "place", "file_start")
    return docs.join(starts, ["range", "place"]).select(
        F.col("key").alias(key), (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """(path, range, place, n_ids, file_start) of every file, from its first bytes; the sums go over files, not rows."""
    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [struct.unpack_from(HEAD, h) for h in frame["head"]]
            yield pd.DataFrame({"path": frame["path"], "range": [h[2] for h in found], "place": [h[3] for h in found],
                                "n_ids": [h[4] for h in found]})

    files = _files(spark, path).select("path", F.substring("content", 1, HEAD_BYTES).alias("head")).mapInPandas(
        heads, "path string, range long, place long, n_ids long")
    return running_count(files.withColumn("all", F.lit(0)), ["all"], [F.col("range"), F.col("place")], "n_ids",
                         "file_start").drop("all")


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame, place: str = "start") -> DataFrame:
    """(start, id): the id at each wanted place of the whole sequence; places outside it have no row.

    Places meet files by equality on coarse ranges of places; only files that are asked are read, and each answers by
    rank, without decoding.
    """
    stride = FILE_IDS
    files = spark.read.parquet(f"{path}/{STARTS}").withColumn("stop", F.col("file_start") + F.col("n_ids"))
    covered = files.withColumn("slot", F.explode(F.sequence(
        F.floor(F.col("file_start") / stride), F.floor((F.col("stop") - 1) / stride)))).select(
        "path", "slot", "file_start", "stop")
    asked = wanted.select(F.col(place).cast("long").alias("start")).where("start >= 0").distinct().withColumn(
        "slot", F.floor(F.col("start") / stride))
    met = materialise(asked.join(covered, "slot").where("start >= file_start and start < stop").groupBy(
        "path", "file_start").agg(F.collect_set(F.col("start") - F.col("file_start")).alias("places")), "token-places")
    names = [r["path"] for r in met.select("path").limit(NAMED_FILES + 1).collect()]
    if not names:
        return spark.createDataFrame([], "start long, id long")

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content, first, places in zip(frame["content"], frame["file_start"], frame["places"]):
                file = TokenFile(content)
                yield pd.DataFrame({"start": [first + p for p in places], "id": [file.token(int(p)) for p in places]})

    return _files(spark, names if len(names) <= NAMED_FILES else path).join(met, "path").select("content", "file_start", "places").mapInPandas(
        fetch, "start long, id long")


def encoded_documents(docs: DataFrame, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text",
                      range_chars: int = RANGE_CHARS, file_ids: int = FILE_IDS) -> DataFrame:
    """Write `docs` to a new folder of the shared one and read every document back from the files."""
    path = new_path(docs.sparkSession, "token-files")
    write(docs, path, vocabulary, end_id, key, text, range_chars, file_ids)
    return read_documents(docs.sparkSession, path, key)
