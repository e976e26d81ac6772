"""An inverted index of character 3-grams: which texts hold which terms as substrings, without reading all texts.

`containment.find_terms` reads every text once per batch of terms.  This index reads the postings of a few rare 3-grams of
each term, keeps the texts that hold all of them, and looks for the term itself in those texts only.

A 3-gram is three consecutive characters of the lower-cased text or, in the form `compact`, of its ASCII letters and digits;
it is kept as one number.  Single characters and pairs are grams too, padded, so that a term of any length is found by its own.

Texts are dealt into chunks and have a place in their chunk.  A posting row holds the places of all texts of one chunk, field
and gram as one list, so rows are as many as grams and chunks, not as grams and texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import compact
from ..storage import materialise, packed, shuffles_freed
from .joins import join_small

SIZE = 3
#: Bits of one character in a gram's number; code points are raised by one, so that 0 is the padding.
CHAR_BITS = 21
#: Places of a chunk fit into two bytes.
PLACE_BITS = 15
#: The rarest grams of a term that are looked up.
PROBES = 3
BUCKETS = 64
PARTS = 64
TEXTS_PER_FILE = 200_000
#: Characters that are cut into grams at once, and pairs of gram and place that a task holds before it packs them.
CHARS_AT_ONCE = 1_000_000
PAIRS_AT_ONCE = 3_000_000
#: Up to so many grams are also named in the scan's filter, which leaves out row groups of the sorted postings.
NAMED_GRAMS = 500
FORMS = ("lower", "compact")
POSTINGS = "form string, field string, gram long, chunk long, slice int, n int, places array<smallint>"
TEXTS = "chunk long, place smallint, key string, field string, form string, text string"


@dataclass(frozen=True)
class GramIndex:
    """`postings` (bucket, form, field, gram, batch, chunk, slice, n, places), `grams` (form, gram, df), `texts` (part, batch,
    chunk, place, key, field, form, text), `keys` (batch, chunk, keys by place).

    Slices cut a chunk's texts into parts that a task has packed together.  `repeats` says whether a key has a field twice.
    """

    postings: DataFrame
    grams: DataFrame
    texts: DataFrame
    keys: DataFrame
    buckets: int
    parts: int
    forms: tuple[str, ...]
    repeats: bool


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The three characters from every place of every text as a number, padded at the end, and the text's place in the list."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = np.repeat(np.arange(len(texts)), lengths)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    at = np.arange(len(chars)) + 2 * rows
    padded = np.zeros(len(chars) + 2 * len(texts), np.int64)
    padded[at] = chars
    return padded[at] << 2 * CHAR_BITS | padded[at + 1] << CHAR_BITS | padded[at + 2], rows


def gram_numbers(text: str) -> np.ndarray:
    """The distinct 3-grams of a term, as numbers; the padded one of a shorter term."""
    grams, _ = _windows([text])
    return np.unique(grams[:max(1, len(grams) - 2)])


def _distinct(grams: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, in order."""
    numbers, codes = np.unique(grams, return_inverse=True)
    both = np.sort(codes.astype(np.int64) << PLACE_BITS | places)  # sorting whole numbers beats `np.unique` by hash
    both = both[np.diff(both, prepend=-1) != 0]
    return numbers[both >> PLACE_BITS], both & (1 << PLACE_BITS) - 1


def _with_pieces(grams: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, and those of the single characters and pairs of characters that the padded grams begin with."""
    found = [(grams, places)]
    for bits in (CHAR_BITS, 2 * CHAR_BITS):
        grams, places = _distinct(grams >> bits << bits, places)
        found.append((grams, places))
    return _distinct(np.concatenate([g for g, _ in found]), np.concatenate([p for _, p in found]))


def _segments(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """The texts with their places in the list, some at a time; a very long one in parts that share two characters."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - 2), CHARS_AT_ONCE):
            part = text if len(text) <= CHARS_AT_ONCE else text[start:start + CHARS_AT_ONCE + 2]
            held.append((i, part))
            size += len(part)
            if size >= CHARS_AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of (form, field, chunk, place, text).  A slice ends between texts, so no text is in two of them."""
    names = [c.strip().split()[0] for c in POSTINGS.split(", ")]
    held: dict[tuple[str, str], list] = {}
    slice_, chunk, pairs = 0, None, 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (form, field), found in held.items():
            grams, places = _with_pieces(*_distinct(*(np.concatenate(x) for x in zip(*found))))
            starts = np.flatnonzero(np.diff(grams, prepend=-1))
            ends = np.append(starts, len(grams))
            n = len(starts)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places.astype(np.int16)))
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(form), n), pa.repeat(pa.scalar(field), n), pa.array(grams[starts]),
                pa.repeat(pa.scalar(chunk, pa.int64()), n), pa.repeat(pa.scalar(slice_, pa.int32()), n),
                pa.array(np.diff(ends).astype(np.int32)), lists], names=names)
        held.clear()

    for batch in batches:
        table = batch.to_pandas()
        # A task holds few texts at a time, however long they are.
        table["cut"] = table.text.str.len().cumsum() // CHARS_AT_ONCE
        for (number, _), some in table.groupby(["chunk", "cut"], sort=False):
            if held and (number != chunk or pairs >= PAIRS_AT_ONCE):
                yield from rows()
            if not held:
                chunk, slice_, pairs = number, int(some.place.iloc[0]), 0
            for kind, texts in some.groupby(["form", "field"], sort=False):
                places = texts.place.to_numpy(np.int64)
                for part in _segments(texts.text.tolist()):
                    grams, row = _windows([t for _, t in part])
                    held.setdefault(kind, []).append(_distinct(grams, places[[i for i, _ in part]][row]))
                    pairs += len(held[kind][-1][0])
    if held:
        yield from rows()


def _with_places(shaped: DataFrame) -> DataFrame:
    """Number the texts of each task: `chunk` and, without gaps, `place`."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(first + (ids >> PLACE_BITS)), pa.array((ids & (1 << PLACE_BITS) - 1).astype(np.int16)),
                *batch.columns], names=["chunk", "place", *batch.schema.names])

    return shaped.select("key", "field", "form", "text").mapInArrow(number, TEXTS)


def _with_grams(df: DataFrame, text: str) -> DataFrame:
    @F.pandas_udf("array<long>")
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([gram_numbers(t) for t in batch], dtype=object)

    return df.select(*df.columns, F.explode(numbers(F.col(text))).alias("gram"))


def _shaped(c: Column, form: str) -> Column:
    return compact(c) if form == "compact" else F.lower(c)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("form", "gram"), F.lit(buckets))


def _part(parts: int) -> Column:
    return F.pmod(F.hash("batch", "chunk"), F.lit(parts))


# --- storing -------------------------------------------------------------------------------------------------

def _texts(texts: DataFrame, forms) -> DataFrame:
    """Texts in every form; `texts` has (key, field, text)."""
    given = texts.where(F.col("text").isNotNull() & F.col("key").isNotNull())
    shapes = F.array(*[F.struct(F.lit(f).alias("form"), _shaped(F.col("text"), f).alias("text")) for f in forms])
    return given.select(F.col("key").cast("string").alias("key"), F.col("field").cast("string").alias("field"),
                        F.explode(shapes).alias("s")).select("key", "field", "s.form", "s.text").where("text != ''")


def _append(spark: SparkSession, shaped: DataFrame, path: str, buckets: int, parts: int) -> None:
    """Write a batch.  Its number in `batches` comes last: a batch that was cut short is written again, as its keys are not
    yet known, and what was written of it has keys in no chunk of another batch.

    Texts are written first and once; all else is made from what was written, as places must not change.  The hash of the
    chunk shares a bucket out over more files the more texts there are, however common one gram is.
    """
    with shuffles_freed(spark):
        _write_batch(spark, shaped, path, buckets, parts)


def _write_batch(spark: SparkSession, shaped: DataFrame, path: str, buckets: int, parts: int) -> None:
    batch = uuid.uuid4().int >> 65
    # A chunk is in one part: its texts are written where they were read.
    placed = _with_places(shaped).withColumn("batch", F.lit(batch)).withColumn("part", _part(parts))
    packed(placed).mode("append").partitionBy("part").parquet(f"{path}/texts")
    staged = _read_texts(spark, path).where(F.col("batch") == batch)
    spread = 1 + staged.count() // TEXTS_PER_FILE
    postings = staged.select("form", "field", "chunk", "place", "text").mapInArrow(_pack, POSTINGS).withColumn(
        "batch", F.lit(batch)).withColumn("bucket", _bucket(buckets))
    piece = F.pmod(F.xxhash64("chunk", "slice"), F.lit(spread))
    packed(postings.repartition("bucket", piece).sortWithinPartitions("bucket", "form", "gram")).mode("append").partitionBy(
        "bucket").parquet(f"{path}/postings")
    written = _read_postings(spark, path).where(F.col("batch") == batch)
    packed(written.groupBy("form", "gram").agg(F.sum("n").alias("df"))).mode("append").parquet(f"{path}/grams")
    in_order = F.array_sort(F.collect_list(F.struct("place", "key")))
    packed(staged.groupBy("batch", "chunk").agg(in_order.alias("rows")).select(
        "batch", "chunk", F.col("rows.key").alias("keys"))).mode("append").parquet(f"{path}/keys")
    repeated = not staged.groupBy("form", "field", "key").count().where("count > 1").isEmpty()
    spark.createDataFrame([(batch, repeated)], "batch long, repeated boolean").write.mode("append").parquet(f"{path}/batches")


def write_grams(texts: DataFrame, path: str, forms=("lower",), buckets: int = BUCKETS, parts: int = PARTS) -> None:
    """Write the index of `texts` (key, field, text) to a new path."""
    spark = texts.sparkSession
    (spark.createDataFrame([(buckets, parts, list(forms))], "buckets int, parts int, forms array<string>")
     .write.parquet(f"{path}/settings"))
    _append(spark, _texts(texts, forms), path, buckets, parts)


def _read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{POSTINGS}, batch long, bucket int").parquet(f"{path}/postings")


def _read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{TEXTS}, batch long, part int").parquet(f"{path}/texts")


def read_grams(spark: SparkSession, path: str) -> GramIndex:
    settings = spark.read.parquet(f"{path}/settings").first()
    grams = spark.read.parquet(f"{path}/grams").groupBy("form", "gram").agg(F.sum("df").alias("df"))
    batches = spark.read.parquet(f"{path}/batches").collect()  # one row per batch that was written to the end
    whole = F.col("batch").isin([r["batch"] for r in batches])
    return GramIndex(_read_postings(spark, path), grams, _read_texts(spark, path).where(whole),
                     spark.read.parquet(f"{path}/keys").where(whole), settings["buckets"], settings["parts"],
                     tuple(settings["forms"]), any(r["repeated"] for r in batches))


def extend_grams(spark: SparkSession, path: str, texts: DataFrame) -> None:
    """Add the texts whose keys the index does not hold yet."""
    index = read_grams(spark, path)
    known = index.texts.select("key").distinct()
    fresh = materialise(texts.withColumn("key", F.col("key").cast("string")).join(known, "key", "left_anti"), "fresh-texts")
    if not fresh.isEmpty():
        _append(spark, _texts(fresh, index.forms), path, index.buckets, index.parts)


# --- search --------------------------------------------------------------------------------------------------

def lookups(index: GramIndex, terms: DataFrame, form: str = "lower", probes: int = PROBES) -> DataFrame:
    """(bucket, gram, term, shown, bit, need): the grams to look up for each term, rarest first.

    A text that holds the term holds all of them, so the bits of its grams make up `need`.  Terms with a gram that no text
    holds are left out: nothing can match them.
    """
    given = terms.select(F.lower("term").alias("term")).distinct().withColumn("shown", _shaped(F.col("term"), form))
    asked = materialise(_with_grams(given.where("shown != ''"), "shown"), "term-grams")
    known = index.grams.where(F.col("form") == form).select("gram", "df")
    # A term has no more grams than characters; a gram that no text holds sorts first, without a count.
    sorted_ = asked.join(known, "gram", "left").groupBy("term", "shown").agg(
        F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams")).where("grams[0].df is not null")
    rare = sorted_.select("term", "shown", F.slice("grams", 1, probes).alias("rare"))
    both = rare.select("term", "shown", (F.pow(F.lit(2), F.size("rare")).cast("long") - 1).alias("need"),
                       F.posexplode("rare").alias("place", "g")).select(
        F.col("g.gram").alias("gram"), "term", "shown", F.pow(F.lit(2), F.col("place")).cast("long").alias("bit"), "need")
    both = both.withColumn("form", F.lit(form)).withColumn("bucket", _bucket(index.buckets))
    return materialise(both.drop("form"), "gram-lookups")


def asked_postings(index: GramIndex, wanted: DataFrame, form: str, fields=None) -> DataFrame:
    """The postings in the folders of the wanted grams; of few grams, also only the row groups that may hold them."""
    named = wanted.select("bucket", "gram").distinct().limit(NAMED_GRAMS + 1).collect()
    rows = index.postings.where(F.col("form") == form)
    if len(named) <= NAMED_GRAMS:
        rows = rows.where(F.col("bucket").isin(sorted({r["bucket"] for r in named})) & F.col("gram").isin(
            [r["gram"] for r in named]))
    else:  # at most as many numbers as there are buckets
        rows = rows.where(F.col("bucket").isin([r["bucket"] for r in wanted.select("bucket").distinct().collect()]))
    return rows if fields is None else rows.where(F.col("field").isin(list(fields)))


def candidates(index: GramIndex, wanted: DataFrame, form: str = "lower", fields=None) -> DataFrame:
    """(batch, chunk, field, term, shown, places): the texts of a chunk that hold all looked-up grams of the term."""
    met = join_small(asked_postings(index, wanted, form, fields), wanted, ["bucket", "gram"], spread="chunk")
    lists = met.groupBy("batch", "chunk", "slice", "field", "term", "shown", "need").agg(
        F.sum("bit").alias("bits"), F.collect_list("places").alias("lists")).where("bits = need")
    common = F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0], F.array_intersect)
    return lists.select("batch", "chunk", "field", "term", "shown", common.alias("places")).where(F.size("places") > 0)


def find_terms(index: GramIndex, terms: DataFrame, fields=None, form: str = "lower", probes: int = PROBES) -> DataFrame:
    """All pairs (key, field, term) where the text, in the given form, holds the term; terms come back lower-cased.

    The same rows as `containment.find_terms` gives, without a scan of the texts: postings are read from the folders of the
    looked-up grams, texts from the folders of the candidates.  A term of up to three characters is proved by its gram.
    """
    if form not in index.forms:
        raise ValueError(f"the index was not built for the form {form}")
    wanted = lookups(index, terms, form, probes)
    kept = materialise(candidates(index, wanted, form, fields).withColumn("part", _part(index.parts)), "gram-candidates")
    proved = F.char_length("shown") <= SIZE
    sure = kept.where(proved).join(index.keys, ["batch", "chunk"]).select(
        F.explode(F.transform("places", lambda place: F.col("keys")[place])).alias("key"), "field", "term")
    parts = [r["part"] for r in kept.where(~proved).select("part").distinct().collect()]
    found = sure
    if parts:
        asked = (kept.where(~proved).select("part", "batch", "chunk", "term", "shown", F.explode("places").alias("place"))
                 .groupBy("part", "batch", "chunk", "place").agg(F.collect_list(F.struct("term", "shown")).alias("terms")))
        texts = index.texts.where((F.col("form") == form) & F.col("part").isin(parts)).drop("form")
        held = F.filter("terms", lambda t: F.contains(F.col("text"), t["shown"]))
        checked = texts.join(asked, ["part", "batch", "chunk", "place"]).select("key", "field", F.explode(held["term"]).alias("term"))
        found = sure.unionByName(checked)
    return found.distinct() if index.repeats else found
