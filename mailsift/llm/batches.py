"""Blocks of rows that are written once and met again by number, and keys that several blocks share.

A block holds about `block_bytes` of text.  `shared` tells for each distinct key of each block whether the key occurs
elsewhere: each block sends its keys, without copies, to the part that the key belongs to, as packed arrays; each part
sends back one bit per key.  A key in very many rows thus arrives once per block, not once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import materialise

BLOCK_BYTES = 2 << 20
#: Keys in one part, about; four bytes each.  A part is one task's work.
PART_KEYS = 1_000_000

ONCE, TWICE, MARK = 0, 1, 2


def blocks(df: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES, extra: list[Column] | None = None) -> DataFrame:
    """A stored table (block, keys, lengths, texts, n_bytes) of all rows of `df`; see `texts_of`.  Keys are text.

    `extra` are columns that are carried along, as one Arrow stream per block: `extra`, a binary column.
    """

    carries, any_extra = extra is not None, bool(extra)

    def block(number, keys, texts, size, more) -> pa.RecordBatch:
        lengths = np.array([-1 if t is None else len(t) for t in texts], "<i8").tobytes()
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(t for t in texts if t is not None))
        columns = {"block": pa.array([number], pa.int64()), "keys": pa.array([keys], pa.list_(pa.string())),
                   "lengths": pa.array([lengths], pa.binary()), "texts": pa.array([packed], pa.binary()),
                   "n_bytes": pa.array([size], pa.int64())}
        if any_extra:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, more[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for part in more:
                    stream.write_batch(part)
            columns["extra"] = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        elif carries:
            columns["extra"] = pa.array([b""], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    def pack(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, texts, size, more = [], [], 0, []
        for batch in found:
            others = batch.select(batch.schema.names[2:])
            begin = 0
            for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                keys.append(k)
                texts.append(t)
                size += len(t or b"")
                if size + 16 * len(texts) >= block_bytes:
                    yield block(number, keys, texts, size, [*more, others.slice(begin, i + 1 - begin)])
                    number, keys, texts, size, more, begin = number + 1, [], [], 0, [], i + 1
            if begin < batch.num_rows:
                more.append(others.slice(begin))
        if keys:
            yield block(number, keys, texts, size, more)

    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(text).cast("string").cast("binary").alias("_text"),
                     *(extra or []))
    schema = "block long, keys array<string>, lengths binary, texts binary, n_bytes long"
    return materialise(rows.mapInArrow(pack, schema + ", extra binary" if carries else schema), "blocks")


def texts_of(row) -> list[bytes | None]:
    """The texts of a block in order, in UTF-8."""
    lengths = np.frombuffer(row["lengths"], "<i8")
    data = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=int(np.maximum(lengths, 0).sum()) + 1)
    ends = np.cumsum(np.maximum(lengths, 0)).tolist()
    return [None if n < 0 else data[e - n:e] for n, e in zip(lengths.tolist(), ends)]


def planes(values: np.ndarray) -> bytes:
    """The bytes of equal-sized values, all first bytes first: even high bytes then compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def parts_of(table: DataFrame, keys_per_byte: float, part_keys: int = PART_KEYS) -> int:
    """How many parts the keys of all blocks need."""
    total = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    least = 4 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(total * keys_per_byte / part_keys) + 1)


def split_parts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys by part, the parts in that order, and where each part starts."""
    # numbers of two bytes are sorted by their digits
    part = (keys % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    numbers, starts = np.unique(part[order], return_index=True)
    return order, numbers.astype(np.int64), np.append(starts, len(keys))


Keys = Callable[[pd.Series], tuple[np.ndarray, np.ndarray]]


def shared(table: DataFrame, keys_of: Keys, parts: int, need_mark: bool = False) -> DataFrame:
    """`table` with `bits array<struct<part, bits>>`: one bit for each distinct key of the block, by part.

    `keys_of` gives the distinct keys of a block's row (64 bits, sorted) and a flag for each: TWICE if more than one row
    of the block has it, plus MARK if it counts as a reference.  A key is shared if it is in two blocks or flagged TWICE,
    and, with `need_mark`, MARKed in some block.  Keys are compared by 30 of their bits beside their part, so a few keys
    are called shared that are not; the caller's exact step drops them.
    """

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                keys, flags = keys_of(row)
                order, numbers, starts = split_parts(keys, parts)
                short = (((keys >> np.uint64(34)) << np.uint64(2)) | flags.astype(np.uint64)).astype(np.uint32)[order]
                yield pd.DataFrame({
                    "part": numbers, "block": row["block"],
                    "keys": [short[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(k, np.uint32) for k in frame["keys"]]
        every = np.concatenate(own)
        # a block may have two keys that differ in the other bits only
        value = every >> 2
        names, place, times = np.unique(value, return_inverse=True, return_counts=True)
        again = np.zeros(len(names), bool)
        again[place[(every & TWICE) > 0]] = True
        live = (times > 1) | again
        if need_mark:
            marked = np.zeros(len(names), bool)
            marked[place[(every & MARK) > 0]] = True
            live &= marked
        ends = np.cumsum([len(k) for k in own])
        bits = [np.packbits(b).tobytes() for b in np.split(live[place], ends[:-1])]
        return pd.DataFrame({"block": frame["block"], "part": frame["part"], "bits": bits})

    sent = table.mapInPandas(send, "part long, block long, keys binary")
    met = sent.groupBy("part").applyInPandas(meet, "block long, part long, bits binary")
    bits = met.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("bits"))
    return table.join(bits, "block", "left")


def read_bits(keys: np.ndarray, bits, parts: int) -> np.ndarray:
    """The bit of each distinct key, in the order of `keys_of`."""
    live = np.zeros(len(keys), bool)
    if bits is None or not len(bits):
        return live
    order, numbers, starts = split_parts(keys, parts)
    by_part = {b["part"]: b["bits"] for b in bits}
    for number, a, b in zip(numbers.tolist(), starts[:-1], starts[1:]):
        live[order[a:b]] = np.unpackbits(np.frombuffer(by_part[number], np.uint8), count=b - a).view(bool)
    return live


def distinct_keys(keys: np.ndarray, owner: np.ndarray, mark: np.ndarray | None = None):
    """The distinct keys, their flags, and the place of each row's key among them."""
    names, place = np.unique(keys, return_inverse=True)
    first = np.full(len(names), np.iinfo(np.int64).max)
    last = np.full(len(names), -1)
    np.minimum.at(first, place, owner)
    np.maximum.at(last, place, owner)
    flags = np.where(last > first, TWICE, ONCE).astype(np.uint8)
    if mark is not None:
        flags[place[mark]] |= MARK
    return names, flags, place
