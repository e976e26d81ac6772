"""Query expansion with a glossary, inside the row: the glossary is a fixed table of the package or the caller."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C
from .clean import strip, text_or_empty
from .text import bind, query_terms


def _texts(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _entries(glossary, pick) -> Column:
    """The glossary as one constant: for each entry the words that trigger it and the words it gives."""
    return F.array(*[
        F.struct(_texts(list(dict.fromkeys(w.lower() for w in triggers))).alias("triggers"), _texts(pick(given)).alias("words"))
        for triggers, given in glossary])


def _glossary_entries(glossary):
    return [((key, *variants, *english), (variants, english)) for key, (variants, english) in glossary.items()]


def _collect(lower_query: Column, entries: Column) -> Column:
    """The words of all entries with a trigger in the query, in table order."""
    hits = F.filter(entries, lambda e: F.exists(e["triggers"], lambda w: F.contains(lower_query, w)))
    return F.flatten(F.transform(hits, lambda e: e["words"]))


def variants(c: Column, glossary=C.GLOSSARY, limit: int = C.MAX_EXPANSIONS) -> Column:
    """The query itself and the variants of every glossary entry it touches, in glossary order."""
    table = _entries(_glossary_entries(glossary), lambda entry: entry[0])
    found = bind(strip(text_or_empty(c)), lambda q: F.concat(
        F.array(q), bind(F.lower(q), lambda lower: _collect(lower, table))))
    return F.slice(F.array_distinct(F.filter(found, lambda v: v != "")), 1, limit)


def english_terms(c: Column, glossary=C.GLOSSARY, limit: int = C.MAX_EXPANSIONS) -> Column:
    """The English terms of every glossary entry the query touches, in glossary order."""
    table = _entries(_glossary_entries(glossary), lambda entry: entry[1])
    found = bind(F.lower(text_or_empty(c)), lambda lower: _collect(lower, table))
    return F.slice(F.array_distinct(found), 1, limit)


def rewrite_terms(c: Column, glossary=C.GLOSSARY, synonyms=C.SYNONYMS, limit: int = C.REWRITE_TERMS) -> Column:
    """The query's words followed by glossary terms and synonyms; words that differ by case only count once."""
    terms = _entries(_glossary_entries(glossary), lambda entry: entry[1][:C.REWRITE_TERMS_PER_HIT])
    others = _entries([((word,), words) for word, words in synonyms.items()], lambda words: words)
    found = bind(F.lower(text_or_empty(c)), lambda lower: F.concat(
        query_terms(c), _collect(lower, terms), _collect(lower, others)))

    def first_spellings(words: Column) -> Column:
        return bind(F.transform(words, F.lower), lambda lowered: F.filter(
            words, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1))

    return F.slice(bind(found, first_spellings), 1, limit)


def rewrite(c: Column, glossary=C.GLOSSARY, synonyms=C.SYNONYMS) -> Column:
    """The rewritten query, its terms joined by OR; the query itself when it has no terms."""
    return bind(rewrite_terms(c, glossary, synonyms), lambda terms: F.when(
        F.size(terms) > 0, F.array_join(terms, " OR ")).otherwise(text_or_empty(c)))


def fallback_tokens(c: Column, limit: int = 4, shortest: int = 3) -> Column:
    """The first white-space separated tokens of at least three characters."""
    tokens = F.split(strip(text_or_empty(c)), r"(?U)\s+")
    return F.slice(F.filter(tokens, lambda t: F.length(t) >= shortest), 1, limit)
