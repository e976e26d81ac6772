"""Searches that widen a query: glossary variants with English terms, and the fallback steps for empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.expand import english_terms, fallback_tokens, variants
from ..functions.text import has_hangul
from ..storage import materialise
from .bm25 import Index, match_scores, by_score, only
from .exact import term_hits
from .joins import join_small
from .ngrams import GramIndex
from .ranking import newest_first, top_k

BODY_FIELDS = ("subject", "plaintextbody")


def route(queries: DataFrame) -> DataFrame:
    """Add `mode`: glossary or substring search for Hangul queries, BM25 for all others."""
    english = F.size(english_terms(F.col("query_text"))) > 0
    return queries.withColumn("mode", F.when(
        has_hangul(F.col("query_text")), F.when(english, "glossary").otherwise("ilike")).otherwise("bm25"))


def substring_matches(mail: DataFrame, queries: DataFrame, terms: Column, fields=BODY_FIELDS,
                      grams: GramIndex | None = None) -> DataFrame:
    """(query_id, no) of mails that hold one of the terms in one of the fields, ignoring case.

    `grams` is an index of the fields' texts; without one, all texts are read.
    """
    wanted = queries.select("query_id", F.explode(terms).alias("term")).select(
        "query_id", F.lower("term").alias("term")).distinct()
    hits = term_hits(mail, wanted.select("term"), fields, grams)
    return (join_small(hits, wanted, ["term"], spread="key")
            .select("query_id", F.col("key").alias("no")).distinct())


def bilingual_matches(mail: DataFrame, index: Index, queries: DataFrame, glossary=C.GLOSSARY,
                      grams: GramIndex | None = None) -> DataFrame:
    """Mails that hold a variant (tier 0) or match an English term by BM25 only (tier 1): one row per pair."""
    text = F.col("query_text")
    by_variant = substring_matches(mail, queries, variants(text, glossary), grams=grams).select(
        "query_id", "no", F.lit(0).alias("tier"), F.lit(None).cast("double").alias("bm25_score"))
    english = queries.select("query_id", F.array_join(english_terms(text, glossary), " OR ").alias("query_text"))
    by_english = match_scores(index, english.where(F.col("query_text") != "")).select(
        "query_id", "no", F.lit(1).alias("tier"), "bm25_score")
    return by_variant.unionByName(by_english).groupBy("query_id", "no").agg(
        F.min("tier").alias("tier"), F.max("bm25_score").alias("bm25_score"))


def bilingual_search(mail: DataFrame, index: Index, queries: DataFrame, k: int = C.RESULT_LIMIT,
                     glossary=C.GLOSSARY, allowed: DataFrame | None = None, grams: GramIndex | None = None) -> DataFrame:
    """The best `k` per query: variant hits before English hits, newest first inside each tier.

    Only `allowed` mails (a table with `no`) take part; all do if nothing is said.
    """
    mail = only(mail, allowed)
    found = bilingual_matches(mail, index, queries, glossary, grams).join(mail.select("no", "deliverytime"), "no")
    return top_k(found, ["query_id"], [F.col("tier"), *newest_first()], k, rank="position")


def fallback_search(mail: DataFrame, index: Index, queries: DataFrame, found: DataFrame,
                    k: int = C.RESULT_LIMIT, allowed: DataFrame | None = None,
                    grams: GramIndex | None = None) -> DataFrame:
    """Further steps for the queries without a row in `found`: (query_id, no, stage, position).

    Stage `token`: BM25 on the first tokens of queries with at least two.  Stage `ilike_fb`: substrings of the first
    tokens.  Each stage sees only the queries that are still empty, so its input is written before the next one starts.
    """
    columns = ["query_id", "no", "stage", "position"]
    mail = only(mail, allowed)
    empty = materialise(queries.join(found.select("query_id").distinct(), "query_id", "left_anti"), "empty")
    if empty.isEmpty():
        nothing = {"no": "string", "stage": "string", "position": "int"}
        return empty.select("query_id", *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()])
    tokens = fallback_tokens(F.col("query_text"))
    wordy = empty.where(~has_hangul(F.col("query_text")) & (F.size(tokens) >= 2))
    by_token = materialise(top_k(
        only(match_scores(index, wordy.select("query_id", F.array_join(tokens, " OR ").alias("query_text"))), allowed),
        ["query_id"], by_score("bm25_score"), k, rank="position").withColumn("stage", F.lit("token")), "token-hits")
    still_empty = empty.join(by_token.select("query_id").distinct(), "query_id", "left_anti")
    parts = F.when(F.size(tokens) > 0, tokens).otherwise(F.array("query_text"))
    by_part = substring_matches(mail, still_empty, parts, grams=grams).join(mail.select("no", "deliverytime"), "no")
    by_part = top_k(by_part, ["query_id"], newest_first(), k, rank="position").withColumn("stage", F.lit("ilike_fb"))
    return by_token.select(*columns).unionByName(by_part.select(*columns))


def key_decisions(mail: DataFrame, index: Index, query: str = C.KEY_DECISION_QUERY,
                  k: int = C.KEY_DECISIONS) -> DataFrame:
    """The newest mails that hold a decision word."""
    asked = mail.sparkSession.createDataFrame([(0, query)], "query_id long, query_text string")
    hits = match_scores(index, asked).select("no")
    columns = ["no", "deliverytime", "subject", "sendername", "company_name", C.CASES]
    rows = mail.select([c for c in columns if c in mail.columns]).join(hits, "no", "left_semi")
    return rows.orderBy(*newest_first()).limit(k)
