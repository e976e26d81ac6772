"""Rank fusion: signals of candidate mails, their weighted sum, and the final order.

Candidates are (query_id, no, mail columns, bm25_score, cosine_score, exact_rank, exact_score, exact_tier, match_reason),
queries are (query_id, query_text); missing signal columns count as not found.  There are at most a few hundred candidates per query,
because every search that feeds this step ends in a top-k cut; the rank operators hold for groups of any size all
the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions.clean import text_or_empty, timestamp
from ..functions.entities import decision_signal, entity_map
from ..functions.text import identifier_terms, query_terms
from .exact import field_match, match_reason
from .joins import join_spread
from .ranking import competition_rank

QUERY = ["query_id"]


def rrf(df: DataFrame, value: str, name: str, ascending: bool = False, k: int = C.RRF_K,
        keys: list[str] = QUERY, spread: str = "no") -> DataFrame:
    """Reciprocal rank of a score inside its query; rows without the score get 0."""
    ranked = competition_rank(df, keys, value, "_rank", ascending, spread=spread)
    return ranked.withColumn(name, F.coalesce(1.0 / (k + F.col("_rank")), F.lit(0.0))).drop("_rank")


def rrf_in_candidates(value: Column, ascending: bool = False, k: int = C.RRF_K) -> Column:
    """Reciprocal rank inside a top-k candidate list, as a window column."""
    window = Window.partitionBy(*QUERY).orderBy(value.asc_nulls_last() if ascending else value.desc_nulls_last())
    return F.when(value.isNull(), 0.0).otherwise(1.0 / (k + F.rank().over(window)))


def age_days(time: Column) -> Column:
    """Whole days between the newest mail of the query's candidates and this one."""
    newest = F.max(time).over(Window.partitionBy(*QUERY))
    return F.coalesce(F.floor((F.unix_micros(newest) - F.unix_micros(time)) / 86_400_000_000),
                      F.lit(C.MISSING_AGE_DAYS)).cast("double")


def recency(df: DataFrame, time: str = "deliverytime", keys: list[str] = QUERY, spread: str = "no") -> DataFrame:
    """1 for the newest mail of the query down to 0 for the oldest; 0 for all where no time can be read.

    For groups of any size.  Ages fall as times rise, so one aggregate of the times gives both ends of the scale.
    """
    when = timestamp(F.col(time))
    ends = df.groupBy(*keys).agg(F.max(when).alias("_newest"), F.min(when).alias("_oldest"),
                                 F.count_if(when.isNull()).alias("_undated"), F.count("*").alias("_n"))
    oldest = F.when(F.col("_undated") > 0, F.greatest(_days("_newest", F.col("_oldest")), F.lit(C.MISSING_AGE_DAYS)))
    ends = ends.withColumn("_high", F.coalesce(oldest, _days("_newest", F.col("_oldest"))))
    age = F.coalesce(_days("_newest", when), F.lit(C.MISSING_AGE_DAYS))
    score = (F.when(F.col("_newest").isNull(), 0.0).when(F.col("_high") == 0, 1.0)
             .otherwise(1.0 - age / F.col("_high")))
    return join_spread(df, ends, keys, spread, rows="_n").withColumn("recency_score", score).drop(
        "_newest", "_oldest", "_undated", "_high")


def _days(newest: str, time: Column) -> Column:
    return F.floor((F.unix_micros(newest) - F.unix_micros(time)) / 86_400_000_000)


def _scaled_in_candidates(value: Column) -> Column:
    window = Window.partitionBy(*QUERY)
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(high != 0, 1.0).otherwise(0.0))


def entity_match(df: DataFrame, entities: Column, terms: Column) -> Column:
    """Share of the query's entity values and words that occur in the header fields."""
    text = F.lower(F.concat_ws(" ", *[text_or_empty(F.col(f)) for f in C.ENTITY_FIELDS if f in df.columns]))
    values = F.flatten(F.transform(F.map_values(entities), lambda v: F.slice(v, 1, C.MAX_ENTITY_SCORE_VALUES)))
    wanted = F.concat(values, F.slice(terms, 1, C.MAX_ENTITY_SCORE_TERMS))
    held = F.size(F.filter(wanted, lambda w: F.contains(text, F.lower(w))))
    return F.least(held / F.greatest(F.size(wanted), F.lit(1)), F.lit(1.0))


def _with_missing(df: DataFrame) -> DataFrame:
    kinds = {"bm25_score": "double", "cosine_score": "double", "exact_rank": "int", "exact_score": "double",
             "exact_tier": "int", "match_reason": "string", "deliverytime": "string"}
    missing = {c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def query_features(queries: DataFrame) -> DataFrame:
    """What the signals need to know of a query, worked out once per query: identifiers, words, terms, entities."""
    text = F.col("query_text")
    df = queries.select("query_id", identifier_terms(text).alias("_identifiers"), query_terms(text).alias("_words"),
                        entity_map(text).alias("_entities"))
    return df.withColumn("_terms", F.when(F.size("_identifiers") > 0, F.col("_identifiers")).otherwise(F.col("_words")))


def signals(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Add every signal of the fused score."""
    df = _with_missing(candidates).join(query_features(queries), "query_id")
    df = df.withColumn("_age", age_days(timestamp(F.col("deliverytime"))))
    dated = F.max(timestamp(F.col("deliverytime"))).over(Window.partitionBy(*QUERY)).isNotNull()
    return df.withColumns({
        "bm25_rrf": rrf_in_candidates(F.col("bm25_score")),
        "vector_rrf": rrf_in_candidates(F.col("cosine_score")),
        "exact_rrf": rrf_in_candidates(F.col("exact_rank"), ascending=True),
        "exact_score": F.coalesce("exact_score", F.lit(0.0)),
        "field_match": field_match(df, F.col("_terms")),
        "entity_match": entity_match(df, F.col("_entities"), F.col("_words")),
        "recency_score": F.when(dated, 1.0 - _scaled_in_candidates(F.col("_age"))).otherwise(0.0),
        "decision_signal": decision_signal(F.col("subject"), _column(df, C.CASES)),
        "match_reason": _join_reasons(F.col("match_reason"), match_reason(df, F.col("_terms"))),
    })


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _join_reasons(base: Column, extra: Column) -> Column:
    parts = F.filter(F.array(text_or_empty(base), extra), lambda r: r != "")
    return F.array_join(F.slice(F.array_distinct(parts), 1, C.MAX_REASONS), ", ")


def fused_score(weights=C.FUSION_WEIGHTS) -> Column:
    score = F.lit(0.0)
    for name, weight in weights.items():
        value = F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0)) if name == "exact_score" else F.col(name)
        score = score + weight * value
    return score


def rerank(candidates: DataFrame, queries: DataFrame, weights=C.FUSION_WEIGHTS,
           tier_first: str | None = None) -> DataFrame:
    """Candidates with their fused score and final position.

    Identifier queries with exact hits are ordered by tier and exact rank first.  `tier_first` names a column that
    goes before the score for all queries, for searches whose tiers must stay together.
    """
    df = signals(candidates, queries).withColumn("score", fused_score(weights))
    any_exact = F.max(F.col("exact_rank").isNotNull()).over(Window.partitionBy(*QUERY))
    by_identifier = (F.size("_identifiers") > 0) & any_exact
    df = df.withColumns({
        "_tier": F.when(by_identifier, F.coalesce("exact_tier", F.lit(9))).otherwise(0),
        "_exact": F.when(by_identifier, F.coalesce("exact_rank", F.lit(999_999))).otherwise(0),
    })
    lead = [F.col(tier_first)] if tier_first else []
    order = Window.partitionBy(*QUERY).orderBy(
        *lead, "_tier", "_exact", F.round("score", 9).desc(), "no")
    return df.withColumn("position", F.row_number().over(order)).drop(
        "_identifiers", "_words", "_entities", "_terms", "_age", "_tier", "_exact")

