"""Full-text index as tables, and BM25 search of a table of queries against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions.stem import count_tokens, stem_tokens
from ..functions.text import index_tokens
from ..storage import drop, materialise, new_path, packed, shuffles_freed, store
from .incremental import new_rows
from .joins import is_small, join_small
from .ranking import top_k

POSTING_BUCKETS = 64
#: Mails, per bucket, whose postings fill one file of each bucket.
DOCS_PER_FILE = 2_500
#: Hits of one task, at most; a hit is a query's word in a mail.
HITS_PER_TASK = 1_000_000
# Sums depend in their last digits on the order in which partial sums meet.  Scores are kept to nine places, so that
# equal scores are equal on every run and share their rank.
SCORE_PLACES = 9


@dataclass(frozen=True)
class Index:
    """`postings` (term, no, tf, length), `terms` (term, df), `docs` (no, length); lengths count index tokens."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stop_words: tuple[str, ...] = C.STOP_WORDS
    stemmed: bool = True
    buckets: int | None = None
    counted: tuple[int, int] | None = None
    #: The table that `postings` and `docs` are read from, if the index was built in this session.
    words_path: str | None = None

    def totals(self) -> tuple[int, float]:
        """Number of documents and their mean length; a stored index knows them, any other is counted."""
        n, tokens = self.counted or _totals(self.docs)
        return n, tokens / max(n, 1)


def release(index: Index) -> None:
    """Delete the table that a built index is read from, when it has been written or read for the last time."""
    if index.words_path:
        drop(index.docs.sparkSession, index.words_path)


def _totals(docs: DataFrame) -> tuple[int, int]:
    return tuple(docs.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first())


def tokenised(df: DataFrame, key: str, text: Column, stop_words, stem: bool) -> DataFrame:
    """(key, tokens): index words of the text in order, stemmed if wanted."""
    tokens = df.select(key, index_tokens(text, stop_words).alias("tokens"))
    return stem_tokens(tokens, "tokens") if stem else tokens


def build_index(mail: DataFrame, fields=C.INDEX_FIELDS, stop_words=C.STOP_WORDS, stem: bool = True) -> Index:
    """The index of all fields that the table has.

    A mail's words are counted where it is read, and written once, as postings and lengths are both read from them.  No word
    is shuffled, unless a key comes twice: then its rows of one length count as one.
    """
    present = [f for f in fields if f in mail.columns]
    text = F.concat_ws(" ", *[F.col(f) for f in present])
    tokens = mail.select("no", index_tokens(text, stop_words).alias("tokens"))
    path = new_path(mail.sparkSession, "mail-words")
    counted = store(count_tokens(tokens, "tokens", stem), path)
    postings = counted.select("no", "length", F.inline("words")).select("term", "no", "tf", "length")
    if not counted.groupBy("no").count().where("count > 1").isEmpty():
        postings = postings.groupBy("no", "length", "term").agg(F.sum("tf").alias("tf")).select("term", "no", "tf", "length")
    return Index(postings, document_frequency(postings), counted.select("no", "length"), tuple(stop_words), stem,
                 words_path=path)


def files_per_bucket(docs: int, buckets: int) -> int:
    """Files that a bucket's postings are shared out over, so that none grows with the table."""
    return 1 + docs // (DOCS_PER_FILE * buckets)


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def extend_index(index: Index, new_mail: DataFrame, fields=C.INDEX_FIELDS) -> Index:
    """The index with the mails it does not hold yet.

    Known mails are neither read into it nor counted twice, and a mail that is delivered twice is one mail.
    """
    fresh = new_rows(new_mail, index.docs, "no", F.xxhash64(*new_mail.columns))
    # Written once: a mail whose text differs between deliveries must be the same one in postings and docs.
    added = build_index(materialise(fresh, "new-mail"), fields, index.stop_words, index.stemmed)
    postings = added.postings
    if index.buckets:
        postings = postings.withColumn("bucket", F.pmod(F.hash("term"), F.lit(index.buckets)))
    terms = index.terms.unionByName(added.terms).groupBy("term").agg(F.sum("df").alias("df"))
    return Index(index.postings.unionByName(postings), terms, index.docs.unionByName(added.docs),
                 index.stop_words, index.stemmed, index.buckets)


def write_index(index: Index, path: str, buckets: int = POSTING_BUCKETS) -> None:
    """Write the index.  Postings are partitioned by a hash of the term, so that a search for a few terms reads a
    few folders; the hash of `no` shares each folder out over more files the more mails there are, however common one
    term is.  An index that grows is written to a new path: it reads the old one."""
    postings = index.postings.drop("bucket").withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets)))
    files = files_per_bucket(index.docs.count(), buckets)
    spread = F.pmod(F.hash("no"), F.lit(files))
    spark = index.postings.sparkSession
    dealt = postings.repartition(buckets * files, "bucket", spread).sortWithinPartitions("bucket", "term")
    with shuffles_freed(spark):
        packed(dealt).mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        packed(document_frequency(spark.read.parquet(f"{path}/postings"))).mode("overwrite").parquet(f"{path}/terms")
        packed(index.docs).mode("overwrite").parquet(f"{path}/docs")
    settings = [(list(index.stop_words), index.stemmed, buckets, *_totals(spark.read.parquet(f"{path}/docs")))]
    (spark.createDataFrame(settings, "stop_words array<string>, stemmed boolean, buckets int, n long, tokens long")
     .write.mode("overwrite").parquet(f"{path}/settings"))


def read_index(spark: SparkSession, path: str) -> Index:
    settings = spark.read.parquet(f"{path}/settings").first()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"),
                 spark.read.parquet(f"{path}/docs"), tuple(settings["stop_words"]), settings["stemmed"], settings["buckets"],
                 (settings["n"], settings["tokens"]))


def query_words(queries: DataFrame, stop_words=C.STOP_WORDS, stem: bool = True) -> DataFrame:
    """Distinct index terms of every query: (query_id, term)."""
    words = tokenised(queries, "query_id", F.col("query_text"), stop_words, stem)
    return words.select("query_id", F.explode_outer("tokens").alias("term")).where(
        F.col("term").isNotNull()).distinct()


def weighted_words(index: Index, queries: DataFrame) -> DataFrame:
    """(term, query_id, df, idf[, bucket]) of the queries' words that the index has, written once.  The logarithm has base 10."""
    n_docs, _ = index.totals()
    words = query_words(queries, index.stop_words, index.stemmed)
    idf = F.log10((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = words.join(index.terms, "term").select("term", "query_id", "df", idf.alias("idf"))
    if index.buckets:
        weighted = weighted.withColumn("bucket", F.pmod(F.hash("term"), F.lit(index.buckets)))
    return materialise(weighted, "query-terms")


def term_score(tf: Column, length: Column, mean_length: float, k1: float = C.BM25_K1, b: float = C.BM25_B) -> Column:
    """What a word with weight 1 adds to the score; it rises with `tf` and falls with the length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean_length)))


def match_scores(index: Index, queries: DataFrame, k1: float = C.BM25_K1, b: float = C.BM25_B,
                 allowed: DataFrame | None = None) -> DataFrame:
    """BM25 score of every mail that holds a term of the query: (query_id, no, bm25_score).

    If mails are `allowed` (a table with `no`), only they are scored: few of them are known to every task that reads
    postings, so postings of other mails are not shuffled.

    Only postings of query terms take part: the weighted query terms are the small side of the join, whose size is checked
    before it is broadcast.  The postings of a mail meet before the queries do, so that a word is shuffled once for all
    queries that name it, and tasks are as many as the hits ask for, whatever the size of the table.
    """
    weighted = weighted_words(index, queries)
    keys, postings = ["term"], index.postings
    if index.buckets:
        keys = ["bucket", "term"]
        # At most as many numbers as there are buckets; only the folders of these are listed and read.
        asked = [row.bucket for row in weighted.select("bucket").distinct().collect()]
        postings = postings.where(F.col("bucket").isin(asked))
    few = allowed is not None and is_small(allowed)
    if few:
        postings = only(postings, allowed)
    if is_small(weighted):
        rows = weighted.agg(F.sum("df")).first()[0] or 0
        asked = postings.join(F.broadcast(weighted.select(keys)), keys, "left_semi")
        hits = asked.repartition(2 + rows // HITS_PER_TASK, "no").join(F.broadcast(weighted), keys)
    else:
        hits = join_small(postings, weighted, keys, spread="no")
    part = F.col("idf") * term_score(F.col("tf"), F.col("length"), index.totals()[1], k1, b)
    scores = hits.groupBy("query_id", "no").agg(F.round(F.sum(part), SCORE_PLACES).alias("bm25_score"))
    return scores if few else only(scores, allowed).select(scores.columns)


def by_score(score: str, key: str = "no") -> list:
    return [F.col(score).desc_nulls_last(), F.col(key)]


def only(scores: DataFrame, allowed: DataFrame | None, key: str = "no") -> DataFrame:
    """The rows whose mail is allowed; all rows if nothing is said.  Scores keep the whole corpus as their basis.

    Whether the rows are shuffled depends on the number of allowed mails, which is checked, not on the size of their table.
    """
    if allowed is None:
        return scores
    held = allowed.select(key)
    return scores.join(F.broadcast(held) if is_small(held) else held.distinct(), key, "left_semi")


def search(index: Index, queries: DataFrame, k: int = C.RESULT_LIMIT, allowed: DataFrame | None = None) -> DataFrame:
    """The best `k` mails of every query with their position, among the `allowed` ones (a table with `no`)."""
    scores = match_scores(index, queries, allowed=allowed)
    return top_k(scores, ["query_id"], by_score("bm25_score"), k, rank="position")


def match_counts(scores: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Mails found per query, among the allowed ones."""
    return only(scores, allowed).groupBy("query_id").agg(F.count("*").alias("matches"))
