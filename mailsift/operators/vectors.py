"""Embeddings of texts, and exact and approximate search for the nearest vectors of a table of query vectors.

Query tables are (query_id, vector); vector tables are (no, vector) with any further columns.  No search forms the
product of the two tables: pairs are scored block against block as matrix products, and a block emits its best `k`
rows per query only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as C
from ..functions.clean import text_or_empty
from ..functions.text import index_tokens
from ..storage import materialise
from .bm25 import SCORE_PLACES, by_score, only
from .joins import is_small
from .ranking import top_k

BLOCK_ROWS = 4096
BROADCAST_QUERIES = 4096
QUERY_ROWS = 512
#: Numbers in the query vectors that a task holds, 8 bytes each: every group of so many queries gets a copy of the vectors.
GROUP_VALUES = 1 << 22
#: Scores are compared before they are rounded.
LOOSE = 1e-8
KNOWN_WORDS = 1_000_000


# --- embedding -------------------------------------------------------------------------------------------

def _word_counts(lists: pa.ListArray, slots: dict[str, int], width: int) -> np.ndarray:
    """Word counts per list, each word in the dimension given by its hash; a distinct word is hashed once."""
    words = lists.flatten().dictionary_encode()
    for word in words.dictionary.to_pylist():
        if word not in slots:
            slots[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % width
    known = np.array([slots[w] for w in words.dictionary.to_pylist()], dtype=np.int64)
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    places = known[words.indices.to_numpy()] if len(known) else rows
    return np.bincount(rows * width + places, minlength=len(lists) * width).reshape(len(lists), width)


def _embed_words(df: DataFrame, text: str, vector: str, width: int) -> DataFrame:
    """Unit vectors of word counts: the JVM cuts texts into words, Python counts the words of an Arrow batch at once."""
    prepared = df.withColumn("_words", index_tokens(text_or_empty(F.col(text)), ()))
    place = len(df.columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, int] = {}
        for batch in batches:
            if len(slots) > KNOWN_WORDS:
                slots.clear()
            counts = _word_counts(batch.column(place), slots, width)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True).astype("float64"))
            units = (counts / np.where(norms == 0, 1.0, norms)).astype("float32")
            ends = pa.array(np.arange(0, units.size + 1, width, dtype="int32"))
            column = pa.ListArray.from_arrays(ends, pa.array(units.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], column], names=[*batch.schema.names[:place], vector])

    schema = T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))])
    return prepared.mapInArrow(count, schema)


def embed(df: DataFrame, text: str, vector: str = "vector", width: int = C.EMBED_DIM,
          encoder: Callable[[pd.Series], list] | None = None) -> DataFrame:
    """Add a unit vector per text.

    `encoder` turns a series of texts into vectors and runs once per Arrow batch, which is where a sentence model
    plugs in.  Without one, words are hashed to dimensions and counted.
    """
    if encoder is None:
        return _embed_words(df, text, vector, width)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.asarray(v, dtype="float32") for v in encoder(batch)], dtype=object)

    return df.withColumn(vector, vectors(F.col(text)))


# --- similarity ------------------------------------------------------------------------------------------

def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision, NULL when the lengths differ or one is all zero."""
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def norm(v: Column) -> Column:
        return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x)))

    product = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), product / (norm(a) * norm(b)))


def _units(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _first_k(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the `k` best scores of each row; equal scores go by the columns' names."""
    cut = min(k, scores.shape[1])
    worst = -np.partition(-scores, cut - 1, axis=1)[:, cut - 1]
    row, column = np.nonzero(scores >= worst[:, None])
    if len(row) > cut * len(scores):  # ties at the cut
        order = np.lexsort((names[column].astype(str), -scores[row, column], row))
        row, column = row[order], column[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, column = row[place < cut], column[place < cut]
    return row, column


def _best_pairs(query_ids, queries: np.ndarray, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best `k` keys per query; equal scores go by key."""
    keys, vectors = held.key.to_numpy(object), _units(held.vector)
    parts = []
    for start in range(0, len(queries), QUERY_ROWS):
        scores = np.round(queries[start:start + QUERY_ROWS] @ vectors.T, SCORE_PLACES)
        row, column = _first_k(scores, keys, k)
        parts.append(pd.DataFrame({
            "query_id": np.asarray(query_ids)[start + row], "key": keys[column], "cosine_score": scores[row, column]}))
    return pd.concat(parts)


def _best_owners(query_ids, queries: np.ndarray, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best `k` owners per query by their best chunk; equal scores go by owner, and by chunk inside an owner."""
    held = held.sort_values(["owner", "key"], kind="stable")
    keys, vectors = held.key.to_numpy(object), _units(held.vector)
    owners, first = np.unique(held.owner.to_numpy(str), return_index=True)
    ends = np.append(first[1:], len(keys))
    parts = []
    for start in range(0, len(queries), QUERY_ROWS):
        scores = np.round(queries[start:start + QUERY_ROWS] @ vectors.T, SCORE_PLACES)
        best = np.maximum.reduceat(scores, first, axis=1)
        row, column = _first_k(best, owners, k)
        chunk = [a + scores[r, a:b].argmax() for r, a, b in zip(row, first[column], ends[column])]
        parts.append(pd.DataFrame({
            "query_id": np.asarray(query_ids)[start + row], "key": keys[chunk], "owner": owners[column],
            "cosine_score": best[row, column]}))
    return pd.concat(parts)


def _keyed(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vector").isNotNull()).select(F.col("no").cast("string").alias("key"), "vector")


def _without_spare_copies(vectors: DataFrame, k: int) -> DataFrame:
    """At most `k` rows of each distinct vector, those with the first keys: no others can be among the best `k`, since
    equal scores go by key.  A group of copies of any size thus takes part with `k` rows.  With owners, the first `k` of
    each vector, each with its first key."""
    if "owner" in vectors.columns:
        firsts = vectors.groupBy("vector", "owner").agg(F.min("key").alias("key"))
        return top_k(firsts, ["vector"], [F.col("owner")], k)
    return top_k(vectors, ["vector"], [F.col("key")], k)


def _queries(queries: DataFrame) -> DataFrame:
    return queries.where(F.col("vector").isNotNull()).select("query_id", "vector")


def _pair_schema(queries: DataFrame, owned: bool = False) -> T.StructType:
    """Scored pairs; query ids keep their type."""
    owner = [T.StructField("owner", T.StringType())] if owned else []
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                         T.StructField("key", T.StringType()), *owner, T.StructField("cosine_score", T.DoubleType())])


class _Block:
    """A block of vectors in the order of their keys or, with owners, in that of owners and keys."""

    def __init__(self, block: pa.RecordBatch, owned: bool):
        names = ["owner", "key"] if owned else ["key"]
        table = block.select(["vector", *names, *(["codes"] if "codes" in block.schema.names else [])]).to_pandas()
        table = table.sort_values(names, kind="stable").reset_index(drop=True)
        self.units, self.keys = _units(table.vector), table.key.to_numpy(object)
        self.owners = table.owner.to_numpy(object) if owned else None
        self.by_code = _rows_by_code(table.codes) if "codes" in table else {None: np.arange(len(table))}


class _Best:
    """The best `k` keys of each query so far or, with owners, the best `k` owners by their best key."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores = np.full((rows, k), -np.inf)
        self.keys, self.owners = np.full((rows, k), "", object), np.full((rows, k), "", object)

    def add(self, queries: np.ndarray, scores: np.ndarray, keys: np.ndarray, owners: np.ndarray | None) -> None:
        """Take in the scores of some queries, each there once, and some vectors of a block in the block's order."""
        whole = scores
        if owners is not None:
            first = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
            ends = np.append(first[1:], len(owners))
            scores = np.maximum.reduceat(scores, first, axis=1)
        least = self.scores[queries, -1][:, None] - LOOSE
        near = scores >= least
        if scores.shape[1] > self.k and np.count_nonzero(near) > 4 * self.k * len(queries):
            worst = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1][:, None]
            near &= scores >= worst - LOOSE
        row, column = np.nonzero(near)
        if not len(row):
            return
        # Of this block: the best k of each query, equal scores in the order of names.
        row, column, score, _ = _cut(row, np.round(scores[row, column], SCORE_PLACES), column, self.k)
        if owners is None:
            key = owner = keys[column]
        else:
            chunk = [a + np.round(whole[r, a:b], SCORE_PLACES).argmax() for r, a, b in zip(row, first[column], ends[column])]
            key, owner = keys[chunk], owners[first[column]]
        # With those from before.
        touched, row = np.unique(row, return_inverse=True)
        at = queries[touched]
        old, place = np.nonzero(self.scores[at] > -np.inf)
        row, score = np.concatenate([row, old]), np.concatenate([score, self.scores[at[old], place]])
        key = np.concatenate([key, self.keys[at[old], place]])
        owner = np.concatenate([owner, self.owners[at[old], place]])
        if owners is not None:  # an owner counts once, with the first key of its best score
            order = np.lexsort((key.astype(str), -score, owner.astype(str), row))
            row, score, key, owner = row[order], score[order], key[order], owner[order]
            once = np.append(True, (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]))
            row, score, key, owner = row[once], score[once], key[once], owner[once]
        row, kept, score, place = _cut(row, score, owner.astype(str), self.k, np.arange(len(row)))
        self.scores[at] = -np.inf
        self.scores[at[row], place], self.keys[at[row], place], self.owners[at[row], place] = score, key[kept], owner[kept]

    def rows(self, query_ids: pa.Array, owned: bool) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "key", *(["owner"] if owned else []), "cosine_score"]
        for start in range(0, len(self.scores), QUERY_ROWS):
            row, place = np.nonzero(self.scores[start:start + QUERY_ROWS] > -np.inf)
            row += start
            yield pa.RecordBatch.from_arrays([
                query_ids.take(pa.array(row)), pa.array(self.keys[row, place], pa.string()),
                *([pa.array(self.owners[row, place], pa.string())] if owned else []), pa.array(self.scores[row, place])], names=names)


def _cut(row: np.ndarray, score: np.ndarray, name: np.ndarray, k: int, given: np.ndarray | None = None) -> tuple:
    """Row, name (or what is `given`), score and place of the best `k` of each row; equal scores go by name."""
    order = np.lexsort((name, -score, row))
    row, score, given = row[order], score[order], (name if given is None else given)[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    return row[kept], given[kept], score[kept], place[kept]


def _rows_by_code(codes: pd.Series) -> dict[int, np.ndarray]:
    """The rows that name each code."""
    flat = np.concatenate([np.asarray(c, np.int64) for c in codes])
    rows = np.repeat(np.arange(len(codes)), codes.map(len).to_numpy())
    order = np.argsort(flat, kind="stable")
    names, starts = np.unique(flat[order], return_index=True)
    return dict(zip(names.tolist(), np.split(rows[order], starts[1:])))


def score_groups(queries: DataFrame, vectors: DataFrame, groups: int, k: int, block_rows: int) -> DataFrame:
    """Score the queries of each `group` against the vectors that were sent to the group, block by block.

    A task holds the queries of a group with their best `k` so far and reads the vectors as a stream, `block_rows` at a time,
    so what it sends grows with queries and not with pairs of blocks.  If both sides have `codes`, a query meets the vectors
    that share one with it; a pair that shares several comes as often, unless vectors have an `owner`.
    """
    owned, coded = "owner" in vectors.columns, "codes" in vectors.columns
    schema = _pair_schema(queries, owned)
    kind = queries.schema["query_id"].dataType

    def side(df: DataFrame, first: bool) -> DataFrame:
        names = ["key", *(["owner"] if owned else [])]
        return df.select(
            F.col("group").cast("int").alias("group"), F.lit(0 if first else 1).alias("side"),
            (F.col("query_id") if first else F.lit(None).cast(kind)).alias("query_id"),
            *[(F.lit(None).cast("string") if first else F.col(c)).alias(c) for c in names],
            "vector", *([F.col("codes").cast("array<long>").alias("codes")] if coded else []))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, held = None, [], None
        for batch in batches:
            numbers, marks = batch.column("group").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(marks) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(marks)]):
                part = batch.slice(start, stop - start)
                if numbers[start] != group:  # a task may have several groups, one after another
                    if held:
                        yield from held[3].rows(held[0], owned)
                    group, asked, held = numbers[start], [], None
                if marks[start] == 0:  # in each, queries come first
                    asked.append(part)
                    continue
                if not asked:
                    continue
                if not held:
                    table = pa.Table.from_batches(asked)
                    units = _units(table.column("vector").to_pandas())
                    wanted = _rows_by_code(table.column("codes").to_pandas()) if coded else {None: np.arange(len(units))}
                    held = table.column("query_id").combine_chunks(), units, wanted, _Best(len(units), k)
                _, units, wanted, best = held
                for low in range(0, part.num_rows, block_rows):
                    block = _Block(part.slice(low, block_rows), owned)
                    for code, columns in block.by_code.items():
                        right, rows = block.units[columns].T, wanted.get(code, ())
                        keys, owners = block.keys[columns], block.owners[columns] if owned else None
                        for at in range(0, len(rows), QUERY_ROWS):
                            some = rows[at:at + QUERY_ROWS]
                            best.add(some, units[some] @ right, keys, owners)
        if held:
            yield from held[3].rows(held[0], owned)

    both = side(queries, True).unionByName(side(vectors, False))
    return both.repartitionById(groups, "group").sortWithinPartitions("group", "side").mapInArrow(score, schema)


def group_counts(queries: DataFrame, vectors: DataFrame, block_rows: int) -> tuple[int, int]:
    """How many groups the queries and how many the vectors are dealt into: a task holds GROUP_VALUES numbers of queries, or a
    block of them, and no core is without a task where there are blocks enough."""
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    held = max(block_rows, GROUP_VALUES // max(width, 1))
    query_groups = max(1, -(-n // held))
    blocks = max(1, -(-vectors.count() // block_rows))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return query_groups, min(blocks, -(-2 * cores // query_groups))


def _spread(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def _copies(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def candidate_pairs(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS,
                    broadcast_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """Per query, a set of scored pairs that holds its exact best `k`.

    Up to `broadcast_queries` queries travel to the vectors, which are then not shuffled at all.  More queries are
    dealt into groups (`score_groups`); every block of vectors meets every group once, and no block exceeds `block_rows` rows.
    """
    return _candidates(_queries(queries), _keyed(vectors), k, block_rows, broadcast_queries)


def owner_pairs(queries: DataFrame, chunk_vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS,
                broadcast_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """Per query, a set of (query_id, key, owner, cosine_score) that holds the best chunks of its exact best `k` owners.

    Every block sends its best `k` owners: an owner among the best `k` of all has fewer than `k` owners before it in the
    block of its best chunk.
    """
    held = chunk_vectors.where(F.col("vector").isNotNull() & F.col("no").isNotNull()).select(
        F.col("chunk_id").cast("string").alias("key"), F.col("no").cast("string").alias("owner"), "vector")
    return _candidates(_queries(queries), held, k, block_rows, broadcast_queries)


def _candidates(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int, broadcast_queries: int) -> DataFrame:
    if is_small(queries, broadcast_queries):
        return _score_against_all(queries, vectors, k)
    vectors = materialise(_without_spare_copies(vectors, k), "vectors")
    return _in_groups(queries, vectors, k, block_rows)


def _in_groups(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int) -> DataFrame:
    """All queries against all vectors: each group of queries meets each group of vectors in a task."""
    query_groups, vector_groups = group_counts(queries, vectors, block_rows)
    left = queries.withColumn("qg", _spread("query_id", query_groups)).withColumn("vg", _copies(vector_groups))
    right = vectors.withColumn("vg", _spread("key", vector_groups)).withColumn("qg", _copies(query_groups))
    group = (F.col("qg") * vector_groups + F.col("vg")).alias("group")
    return score_groups(left.select("*", group), right.select("*", group), query_groups * vector_groups, k, block_rows)


def _score_against_all(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    schema = _pair_schema(queries, "owner" in vectors.columns)
    best = _best_owners if "owner" in vectors.columns else _best_pairs
    rows = queries.collect()
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema)
    ids = vectors.sparkSession.sparkContext.broadcast(
        (np.array([r.query_id for r in rows]), _units([r.vector for r in rows])))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix = ids.value
        for batch in batches:
            if len(batch):
                yield best(query_ids, matrix, batch, k)

    return vectors.mapInPandas(score, schema)


def best_pairs(pairs: DataFrame, k: int) -> DataFrame:
    ranked = top_k(pairs, ["query_id"], by_score("cosine_score", "key"), k, rank="position")
    return ranked.select("query_id", F.col("key").alias("no"), "cosine_score", "position")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None,
            allowed: DataFrame | None = None) -> DataFrame:
    """The exact nearest `k` vectors of every query, among the `allowed` mails; `min_score` leaves out weaker ones."""
    pairs = candidate_pairs(queries, only(vectors, allowed), k)
    if min_score is not None:
        pairs = pairs.where(F.col("cosine_score") >= min_score)
    return best_pairs(pairs, k)


def similar_documents(vectors: DataFrame, k: int = C.SIMILAR_DOCUMENTS) -> DataFrame:
    """The nearest `k` other documents of every document.

    Exact for a whole table means work in the square of its size; for very many documents ask for some of them with
    `nearest`, or use `nearest_approximate`.
    """
    queries = vectors.select(F.col("no").alias("query_id"), "vector")
    pairs = candidate_pairs(queries, vectors, k + 1)
    return best_pairs(pairs.where(F.col("key") != F.col("query_id").cast("string")), k)


def nearest_by_chunk(queries: DataFrame, chunk_vectors: DataFrame, k: int, overfetch: int | None = None,
                     allowed: DataFrame | None = None, block_rows: int = BLOCK_ROWS,
                     broadcast_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """The best `k` mails per query by their best chunk; `k` mails whenever there are as many.

    `chunk_vectors` has (no, chunk_id, section, chunk_text, vector).  With `overfetch`, only the mails among the best
    `k * overfetch` chunks take part, which are fewer than `k` where few mails own them.  Texts are joined to the surviving
    chunks only.
    """
    chunk_vectors = only(chunk_vectors, allowed)
    if overfetch is None:
        pairs = owner_pairs(queries, chunk_vectors, k, block_rows, broadcast_queries)
        hits = pairs.select("query_id", F.col("key").alias("chunk_id"), F.col("owner").alias("no"), "cosine_score")
    else:
        chunks = chunk_vectors.select(F.col("chunk_id").alias("no"), "vector")
        found = nearest(queries, chunks, k * overfetch).withColumnRenamed("no", "chunk_id").drop("position")
        hits = found.join(chunk_vectors.select("chunk_id", "no"), "chunk_id")
    best = hits.groupBy("query_id", "no").agg(F.min(F.struct((-F.col("cosine_score")).alias("minus"), "chunk_id")).alias("b"))
    rows = best.select("query_id", "no", F.col("b.chunk_id").alias("chunk_id"), (-F.col("b.minus")).alias("cosine_score"))
    cut = top_k(rows, ["query_id"], by_score("cosine_score"), k, rank="position")
    texts = chunk_vectors.select("no", "chunk_id", "section", "chunk_text")
    return cut.join(texts, ["no", "chunk_id"]).select(
        "query_id", "no", "chunk_id", "section", "chunk_text", "cosine_score", "position")


# --- approximate search ----------------------------------------------------------------------------------

def planes_of(tables: int, bits: int, width: int) -> np.ndarray:
    """Projections on vectors of 1 and -1: the sign comes from the md5 of `table,bit,dimension`."""
    def sign(*place: int) -> int:
        return 1 if hashlib.md5(",".join(map(str, place)).encode()).hexdigest()[0] < "8" else -1

    return np.array([[[sign(t, b, d) for d in range(width)] for b in range(bits)] for t in range(tables)], float)


def signatures(df: DataFrame, tables: int, bits: int, width: int) -> DataFrame:
    """One row per vector and table with the signs of `bits` projections: near vectors often agree."""
    signed = _signed(df, tables, bits, width)
    return signed.select(*df.columns, F.posexplode("signs").alias("table", "code"))


def _signed(df: DataFrame, tables: int, bits: int, width: int) -> DataFrame:
    """Add `signs`, the code of each table."""
    planes = planes_of(tables, bits, width)
    powers = 2 ** np.arange(bits)

    @F.pandas_udf("array<long>")
    def codes(batch: pd.Series) -> pd.Series:
        signs = np.einsum("nd,tbd->ntb", _units(batch), planes) > 0
        return pd.Series(list(signs @ powers)) if len(batch) else pd.Series([], dtype=object)

    return df.withColumn("signs", codes("vector"))


def _flips(bits: int) -> list[int]:
    return [0, *[2 ** b for b in range(bits)]]


def _codes(bits: int, flips: list[int]) -> Column:
    """The codes of all tables, each number telling its table too, as they are and with each of the flips."""
    return F.flatten(F.transform("signs", lambda code, table: F.array(*[
        (table * 2 ** bits + code.bitwiseXOR(F.lit(f).cast("long"))).cast("long") for f in flips])))


def probes(df: DataFrame, bits: int) -> DataFrame:
    """The code itself and every code that differs in one bit."""
    flips = F.array(*[F.lit(f) for f in _flips(bits)])
    return df.withColumn("code", F.explode(F.transform(flips, lambda f: F.col("code").bitwiseXOR(f.cast("long")))))


def _met(queries: DataFrame, vectors: DataFrame, k: int, width: int, tables: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of the vectors, and those that the queries look up."""
    return (signatures(_without_spare_copies(_keyed(vectors), k), tables, bits, width),
            probes(signatures(_queries(queries), tables, bits, width), bits))


def scored_share(queries: DataFrame, vectors: DataFrame, k: int, width: int, tables: int, bits: int) -> DataFrame:
    """Pairs that `nearest_approximate` scores, by all pairs there are: its work against that of an exact search."""
    held, asked = _met(queries, vectors, k, width, tables, bits)
    left = asked.groupBy("table", "code").agg(F.count("*").alias("a"))
    right = held.groupBy("table", "code").agg(F.count("*").alias("b"))
    every = _queries(queries).count() * _keyed(vectors).count()
    scored = left.join(right, ["table", "code"]).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("scored"))
    return scored.withColumn("share", F.col("scored") / F.lit(float(max(every, 1))))


def nearest_approximate(queries: DataFrame, vectors: DataFrame, k: int, width: int, tables: int, bits: int,
                        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest `k` among the vectors that share a signature, or one with a single bit changed, with the query.

    More bits score fewer pairs and find fewer neighbours, more tables both more; `scored_share` and `recall_against`
    measure them.  Scores are exact; a true neighbour is missed only when no table brings it together with the query.
    Queries and vectors travel with their signatures, once for each group and not once for each signature; a task scores
    the pairs that share one, block by block, so a bucket of any size is scored in parts.
    """
    held = _signed(_without_spare_copies(_keyed(vectors), k), tables, bits, width)
    held = materialise(held.select("key", F.col("key").alias("owner"), "vector", _codes(bits, [0]).alias("codes")), "signed-vectors")
    asked = _signed(_queries(queries), tables, bits, width).select("query_id", "vector", _codes(bits, _flips(bits)).alias("codes"))
    pairs = _in_groups(asked, held, k, block_rows)
    once = pairs.groupBy("query_id", "key").agg(F.max("cosine_score").alias("cosine_score"))
    return best_pairs(once, k)


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found, over all queries."""
    keys = ["query_id", "no"]
    marked = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return marked.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"), F.count("*").alias("pairs"))
