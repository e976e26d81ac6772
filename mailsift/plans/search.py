"""Whole searches: from a table of queries and a mail table to ranked, explained, masked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.clean import id_value, mail_display_columns
from ..functions.entities import chip_text, entity_map, merge_entities
from ..functions.expand import rewrite
from ..functions.text import has_hangul, mask_addresses, search_terms, snippet
from ..operators.bilingual import bilingual_search, fallback_search
from ..operators.bm25 import Index, only, search
from ..operators.exact import exact_search, merge_exact
from ..operators.fusion import rerank
from ..operators.joins import join_small
from ..operators.ngrams import GramIndex
from ..operators.vectors import nearest, nearest_by_chunk
from ..storage import materialise

HIT = ["query_id", "no", "bm25_score", "tier", "mode"]


def primary_hits(mail: DataFrame, index: Index, queries: DataFrame, k: int = C.RESULT_LIMIT,
                 rewrite_queries: bool = False, glossary=C.GLOSSARY, synonyms=C.SYNONYMS,
                 allowed: DataFrame | None = None, grams: GramIndex | None = None) -> DataFrame:
    """Glossary search for Hangul queries and BM25 for all others, each on its own queries."""
    hangul = has_hangul(F.col("query_text"))
    plain = _asked(queries.where(~hangul), rewrite_queries, glossary, synonyms)
    by_words = search(index, plain, k, allowed).select(
        "query_id", "no", "bm25_score", F.lit(0).alias("tier"), F.lit("bm25").alias("mode"))
    foreign = queries.where(hangul)
    if foreign.isEmpty():
        return by_words
    by_glossary = bilingual_search(mail, index, foreign, k, glossary, allowed, grams).select(
        "query_id", "no", "bm25_score", "tier", F.lit("glossary").alias("mode"))
    return by_words.unionByName(by_glossary)


def _asked(queries: DataFrame, rewrite_queries: bool, glossary, synonyms) -> DataFrame:
    """The texts that BM25 is asked with: rewritten if wanted; queries for the glossary stay as they are."""
    if not rewrite_queries:
        return queries
    text = F.col("query_text")
    return queries.withColumn("query_text", F.when(has_hangul(text), text).otherwise(rewrite(text, glossary, synonyms)))


def keyword_search(mail: DataFrame, index: Index, queries: DataFrame, k: int = C.RESULT_LIMIT,
                   rewrite_queries: bool = False, glossary=C.GLOSSARY, synonyms=C.SYNONYMS,
                   allowed: DataFrame | None = None, grams: GramIndex | None = None) -> DataFrame:
    """Primary hits, exact identifier hits laid over them, fallback steps for empty queries, then the rerank.

    Hits are ids and scores until the last step; they are written once, because later steps read them several times, and
    travel to the mails, which are not shuffled.  Only
    `allowed` mails (a table with `no`) are hits of any step; scores keep the whole corpus as their basis.  With `grams`, a
    gram index of the mails' texts, no step reads all texts.
    """
    mail = only(mail, allowed)
    primary = primary_hits(mail, index, queries, k, rewrite_queries, glossary, synonyms, allowed, grams)
    exact = exact_search(mail, queries, k, grams=grams)
    found = materialise(merge_exact(primary, exact), "hits")
    fallback = fallback_search(mail, index, queries, found, k, allowed, grams).select(
        "query_id", "no", F.col("stage").alias("mode"))
    hits = materialise(found.unionByName(fallback, allowMissingColumns=True).withColumn(
        "mode", F.coalesce("mode", F.lit("exact"))), "all-hits")
    return rerank(_with_mails(hits, mail), _asked(queries, rewrite_queries, glossary, synonyms))


def _with_mails(hits: DataFrame, mail: DataFrame) -> DataFrame:
    """Stored hits with the shown columns of their mails."""
    columns = [c for c in (*C.RESULT_COLUMNS, *C.OPTIONAL_COLUMNS) if c in mail.columns and c != "no"]
    return join_small(mail.select("no", *columns), hits, ["no"], spread="no")


def hybrid_search(mail: DataFrame, index: Index, queries: DataFrame, query_vectors: DataFrame, vectors: DataFrame,
                  k: int, rewrite_queries: bool = True, glossary=C.GLOSSARY, synonyms=C.SYNONYMS,
                  allowed: DataFrame | None = None) -> DataFrame:
    """Vector hits and BM25 hits in one candidate list, `2k` of each, fused and cut to `k`.

    `vectors` may hold mails (no, vector) or chunks (no, chunk_id, section, chunk_text, vector).  Only `allowed` mails
    (a table with `no`) are hits of either search.
    """
    chunked = "chunk_id" in vectors.columns
    by_vector = (nearest_by_chunk if chunked else nearest)(query_vectors, vectors, 2 * k, allowed=allowed)
    asked = queries
    if rewrite_queries:
        asked = queries.withColumn("query_text", rewrite(F.col("query_text"), glossary, synonyms))
    by_words = search(index, asked, 2 * k, allowed).select("query_id", "no", "bm25_score")
    hits = materialise(by_vector.drop("position").join(by_words, ["query_id", "no"], "full_outer"), "hits")
    return rerank(_with_mails(hits, mail), asked).where(F.col("position") <= k)


def presented(results: DataFrame, mail: DataFrame, queries: DataFrame) -> DataFrame:
    """Display form of ranked results: snippet, entity chips, masked addresses, readable ids, months, times and sites.

    Bodies are joined to the ranked results only.
    """
    text = F.col("query_text")
    asked = queries.select("query_id", search_terms(text).alias("_terms"), entity_map(text).alias("_asked"))
    rows = (results.join(asked, "query_id")
            .join(mail.select("no", "plaintextbody"), "no", "left"))
    header = F.concat_ws(" ", *[F.col(c) for c in (
        "subject", "sendername", "company_name", "site", "stage", C.CASES, "plaintextbody") if c in rows.columns])
    chips = chip_text(merge_entities([F.col("_asked"), entity_map(header)]))
    rows = rows.withColumns({
        "snippet": snippet(F.col("plaintextbody"), F.col("_terms")), "entities": chips})
    shown = mail_display_columns(rows.columns)
    for name in ("senderemail", "recipientto"):
        if name in rows.columns:
            shown[name] = mask_addresses(F.col(name))
    return rows.drop("plaintextbody", "_terms", "_asked").withColumns(shown).withColumn("no", id_value(F.col("no")))
