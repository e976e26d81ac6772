"""Search by identifier: case, order and document numbers in any spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.clean import any_of, id_key, id_value, text_or_empty
from ..functions.text import (bind, identifier_terms, names_any, names_term, search_terms, searchable,
                              term_forms)
from ..storage import materialise
from .bm25 import only
from .containment import find_terms, text_fields
from .joins import join_small
from .ngrams import GramIndex, find_terms as find_by_grams
from .ranking import newest_first, top_k


def identifier_queries(queries: DataFrame) -> DataFrame:
    """Queries that name an identifier, with their terms: (query_id, query_text, terms)."""
    return queries.withColumn("terms", identifier_terms(F.col("query_text"))).where(F.size("terms") > 0)


def _id_only(term: Column) -> Column:
    """Short numbers, years and year-months would hit everywhere as substrings, so they match ids only."""
    return term.rlike(r"^\d{1,5}$") | term.rlike(r"^20\d{2}$") | term.rlike(r"^20\d{4}$")


def find_matches(mail: DataFrame, queries: DataFrame, fields=C.EXACT_FIELDS, allowed: DataFrame | None = None,
                 grams: GramIndex | None = None) -> DataFrame:
    """Every (query_id, no) where a term equals the id or occurs in a field, and the best tier of the pair.

    Tier 0: a term is the id.  Tier 1: a term occurs in a field other than the body, spelled in any way.  Tier 2: in
    the body only.  `grams` is an index of the fields' texts (`ngrams.write_grams`); without one, all texts are read.
    """
    return _matches(only(mail, allowed), materialise(identifier_queries(queries), "identifiers"), fields, grams)


def term_hits(mail: DataFrame, terms: DataFrame, fields, grams: GramIndex | None) -> DataFrame:
    """(key, field, term) of the mails whose fields hold a term, by the index or, without one, by reading the fields."""
    if grams is None:
        return find_terms(text_fields(mail, "no", fields), terms)
    return only(find_by_grams(grams, terms, [f for f in fields if f in mail.columns]),
                mail.select(F.col("no").cast("string").alias("key")), "key")


def _matches(mail: DataFrame, asked: DataFrame, fields, grams: GramIndex | None) -> DataFrame:
    terms = asked.select("query_id", F.explode("terms").alias("term"))
    by_id = (mail.select("no", id_key(F.col("no")).alias("key"))
             .join(terms.select("query_id", id_value(F.col("term")).alias("key")).distinct(), "key")
             .select("query_id", "no", F.lit(0).alias("tier")))
    wordy = terms.where(~_id_only(id_value(F.col("term")))).withColumn("term", F.lower("term")).distinct()
    hits = term_hits(mail, wordy.select("term"), fields, grams)
    in_text = (join_small(hits, wordy, ["term"], spread="key")
               .select("query_id", F.col("key").alias("no"),
                       F.when(F.col("field") == "plaintextbody", 2).otherwise(1).alias("tier")))
    found = by_id.unionByName(in_text).groupBy("query_id", "no").agg(F.min("tier").alias("exact_tier"))
    return found


def _raise_tier(df: DataFrame) -> DataFrame:
    """A mail found by its body counts as tier 1 where a strong field holds a term in another spelling."""
    strong = bind(term_forms(F.col("terms")), lambda forms: any_of([
        names_any(text_or_empty(F.col(f)), forms) for f in C.STRONG_FIELDS if f in df.columns]))
    return df.withColumn("exact_tier", F.when((F.col("exact_tier") == 2) & strong, 1).otherwise(F.col("exact_tier")))


def exact_search(mail: DataFrame, queries: DataFrame, limit: int = C.RESULT_LIMIT,
                 allowed: DataFrame | None = None, grams: GramIndex | None = None) -> DataFrame:
    """The first `limit` mails per identifier query, by tier and then newest first, with rank, score and reason.

    Only `allowed` mails (a table with `no`) take part; all do if nothing is said.  See `find_matches` for `grams`.
    """
    mail = only(mail, allowed)
    asked = materialise(identifier_queries(queries), "identifiers")
    found = _matches(mail, asked, C.EXACT_FIELDS, grams)
    columns = [c for c in (*C.RESULT_COLUMNS, *C.OPTIONAL_COLUMNS) if c in mail.columns]
    rows = found.join(mail.select(columns), "no").join(asked, "query_id")
    rows = top_k(_raise_tier(rows), ["query_id"], [F.col("exact_tier"), *newest_first()], limit, rank="exact_rank")
    rows = rows.withColumn("exact_score", F.lit(1.0))
    reason = match_reason(rows, F.col("terms"))
    return rows.withColumn("match_reason", F.concat(
        F.lit("exact identifier, "), F.when(reason != "", reason).otherwise("body"))).drop("terms")


def match_reason(df: DataFrame, terms: Column) -> Column:
    """`label:term` for the first field that holds each of the first terms."""
    present = {f: label for f, label in C.FIELD_LABELS.items() if f in df.columns}
    texts = F.struct(*[searchable(text_or_empty(F.col(f))).alias(f) for f in present])

    def reason(fields: Column, term: Column) -> Column:
        return F.coalesce(*[F.when(names_term(fields[f], term), F.concat(F.lit(label + ":"), term["term"]))
                            for f, label in present.items()])

    first = term_forms(F.slice(terms, 1, C.MAX_REASON_TERMS))
    reasons = F.array_compact(bind(texts, lambda fields: F.transform(first, lambda t: reason(fields, t))))
    return F.array_join(F.slice(F.array_distinct(reasons), 1, C.MAX_REASONS), ", ")


def field_match(df: DataFrame, terms: Column, weights=C.FIELD_WEIGHTS) -> Column:
    """Sum of the weights of the fields that hold one of the first terms, at most 1."""
    def total(forms: Column) -> Column:
        score = F.lit(0.0)
        for field, weight in weights.items():
            if field in df.columns:
                held = names_any(text_or_empty(F.col(field)), forms)
                score = score + F.when(held, weight).otherwise(0.0)
        return F.least(score, F.lit(1.0))

    return bind(term_forms(F.slice(terms, 1, C.MAX_FIELD_TERMS)), total)


def merge_exact(primary: DataFrame, exact: DataFrame) -> DataFrame:
    """Primary hits with the exact columns laid over them, and exact hits that the primary search did not find."""
    keys = ["query_id", "no"]
    over = exact.select(*keys, "exact_rank", "exact_score", "exact_tier", "match_reason")
    joined = primary.join(over, keys, "full_outer") if "match_reason" not in primary.columns else (
        primary.withColumnRenamed("match_reason", "_reason").join(over, keys, "full_outer")
        .withColumn("match_reason", F.coalesce("match_reason", "_reason")).drop("_reason"))
    return joined


def total_matches(primary: DataFrame, exact: DataFrame) -> DataFrame:
    """Matches per query when both searches ran: the larger of the two counts.  Both are (query_id, matches)."""
    other = exact.withColumnRenamed("matches", "_exact")
    return primary.join(other, "query_id", "full_outer").select(
        "query_id", F.greatest("matches", "_exact").alias("matches"))


def with_search_terms(queries: DataFrame) -> DataFrame:
    return queries.withColumn("terms", search_terms(F.col("query_text")))
