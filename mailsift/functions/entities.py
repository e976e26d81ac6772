"""Entity tags, issue labels and decision words as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C
from .clean import strip, text_or_empty
from .text import bind, mask_text


def tag_values(c: Column, tag: str, patterns=C.ENTITY_PATTERNS, limit: int | None = C.MAX_ENTITY_VALUES) -> Column:
    """Distinct values of one tag in text order; values of reference tags are masked."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit("(?iU)" + patterns[tag]), F.lit(0))
    clean = F.transform(found, mask_text if tag in C.MASKED_TAGS else strip)
    values = F.array_distinct(F.filter(clean, lambda v: v != ""))
    return F.slice(values, 1, limit) if limit else values


def entity_map(c: Column, patterns=C.ENTITY_PATTERNS) -> Column:
    """tag -> values, tags without a value left out."""
    entries = F.array(*[
        F.struct(F.lit(tag).alias("key"), tag_values(c, tag, patterns).alias("value")) for tag in patterns])
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def _values(entities: Column, tag: str) -> Column:
    return F.coalesce(entities[tag], F.array().cast("array<string>"))


def merge_entities(maps: list[Column], tags=tuple(C.ENTITY_PATTERNS), limit: int = C.MAX_ENTITY_VALUES) -> Column:
    """One map with the values of all maps, earlier maps first."""
    def merged(sources: Column) -> Column:
        entries = F.array(*[
            F.struct(F.lit(tag).alias("key"), F.slice(F.array_distinct(F.concat(*[
                _values(sources[f"m{i}"], tag) for i in range(len(maps))])), 1, limit).alias("value"))
            for tag in tags])
        return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))

    return bind(F.struct(*[m.alias(f"m{i}") for i, m in enumerate(maps)]), merged)


def chip_text(entities: Column, limit: int = C.MAX_CHIP_VALUES) -> Column:
    """`[Tag: a, b, c]` for every tag, in the fixed order."""
    def chip(found: Column, tag: str) -> Column:
        return F.when(F.size(_values(found, tag)) > 0, F.concat(
            F.lit(f"[{tag}: "), F.array_join(F.slice(_values(found, tag), 1, limit), ", "), F.lit("]")))

    return bind(entities, lambda found: F.concat_ws(" ", *[chip(found, tag) for tag in C.CHIP_ORDER]))


def issue_text(subject: Column, cases: Column) -> Column:
    return F.lower(F.concat(text_or_empty(subject), F.lit(" "), text_or_empty(cases)))


def issue_label(subject: Column, cases: Column, keywords=C.ISSUE_KEYWORDS, other: str = C.ISSUE_OTHER) -> Column:
    """The first issue with a keyword in the subject or the cases."""
    text = issue_text(subject, cases)
    labels = [F.when(_holds_any(text, words), label) for label, words in keywords.items()]
    return F.coalesce(*labels, F.lit(other))


def decision_signal(subject: Column, cases: Column, words=C.DECISION_WORDS) -> Column:
    return F.when(_holds_any(issue_text(subject, cases), words), 1.0).otherwise(0.0)


def _holds_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit
