"""Filters over mail: facets, sites, substrings, refinement, and checked filter specifications."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.clean import all_of, any_of, contains_text, escape_like, site_key, text_or_empty
from .ranking import newest_first

def in_values(column: str, values: list[str]) -> Column:
    return F.col(column).isin(*values)


def at_sites(df: DataFrame, selected: list[str], sites=C.SITES) -> Column:
    """Rows whose site columns name one of the selected sites, by code, alias or `CODE (NAME)` label."""
    codes = {alias.lower(): code for code, (_, aliases) in sites.items() for alias in aliases}
    codes |= {f"{code} ({name})".lower(): code for code, (name, _) in sites.items()}
    wanted: list[str] = []
    for text in selected:
        code = codes.get(text.strip().lower())
        wanted += [a.lower() for a in sites[code][1]] if code else [text.strip().lower()]
    wanted = [w for w in dict.fromkeys(wanted) if w and w not in C.SITE_BLANKS]
    if not wanted:
        return F.lit(True)
    present = [c for c in C.SITE_COLUMNS if c in df.columns]
    return any_of([F.coalesce(site_key(F.col(c)).isin(*wanted), F.lit(False)) for c in present])


def search_filter(df: DataFrame, months=(), sites=(), stages=(), sender: str = "", case: str = "",
                  site_table=C.SITES) -> DataFrame:
    """All filters of the search page, each one optional."""
    conditions = []
    if months:
        conditions.append(in_values("month", list(months)))
    if sites:
        conditions.append(at_sites(df, list(sites), site_table))
    if stages:
        conditions.append(in_values("stage", list(stages)))
    if sender:
        conditions.append(contains_text(F.col("senderemail"), sender))
    if case:
        conditions.append(contains_text(F.col(C.CASES), case))
    return df.where(all_of(conditions)) if conditions else df


def refine(df: DataFrame, pattern: str, fields=C.REFINE_FIELDS, literal: bool = False) -> DataFrame:
    """Rows where any of the fields matches the pattern, ignoring case."""
    pattern = re.escape(pattern) if literal else pattern
    return df.where(any_of([text_or_empty(F.col(f)).rlike("(?iu)" + pattern) for f in fields if f in df.columns]))


def _like(column: Column, text: Column, value: str) -> Column:
    return column.cast("string").ilike(f"%{escape_like(value)}%")


# Operator -> (fewest values, most values, condition of the column, the values as columns and the raw values).
# A most of 1 stands for a plain value, more for a list.
OPERATORS = {
    "eq": (1, 1, lambda c, v, raw: c == v[0]),
    "neq": (1, 1, lambda c, v, raw: c != v[0]),
    "gt": (1, 1, lambda c, v, raw: c > v[0]),
    "gte": (1, 1, lambda c, v, raw: c >= v[0]),
    "lt": (1, 1, lambda c, v, raw: c < v[0]),
    "lte": (1, 1, lambda c, v, raw: c <= v[0]),
    "ilike": (1, 1, lambda c, v, raw: _like(c, v[0], raw[0])),
    "not_ilike": (1, 1, lambda c, v, raw: ~_like(c, v[0], raw[0])),
    "in": (1, C.MAX_FILTER_VALUES, lambda c, v, raw: c.isin(*v)),
    "between": (2, 2, lambda c, v, raw: c.between(v[0], v[1])),
}
JOINED = {"and": all_of, "or": any_of}


def _problems(spec: Any) -> Iterator[str]:
    """Everything that keeps a specification from being a condition."""
    if not isinstance(spec, dict) or {"where", "sql"} & set(spec):
        yield "the specification is no object, or holds SQL"
        return
    if str(spec.get("logic", "and")).lower() not in JOINED:
        yield f"logic is none of {', '.join(JOINED)}"
    filters = spec.get("filters", [])
    if not isinstance(filters, list) or len(filters) > C.MAX_FILTERS:
        yield f"filters is no list of at most {C.MAX_FILTERS}"
        return
    for place, item in enumerate(filters):
        if not isinstance(item, dict):
            yield f"filter {place} is no object"
            continue
        field, op, values = _parts(item)
        if field not in C.FILTER_FIELDS:
            yield f"filter {place}: no such field: {field}"
        if op not in OPERATORS:
            yield f"filter {place}: no such operator: {op}"
            continue
        fewest, most, _ = OPERATORS[op]
        if most > 1 and not isinstance(item.get("value"), list) or not fewest <= len(values) <= most:
            yield f"filter {place}: {op} takes {fewest} to {most} values"
        for value in values:
            if type(value) not in (str, int, float):
                yield f"filter {place}: a value is neither text nor number"
            elif len(str(value)) > C.MAX_FILTER_CHARS and isinstance(value, str):
                yield f"filter {place}: a value has more than {C.MAX_FILTER_CHARS} characters"


def _parts(item: dict) -> tuple[str, str, list]:
    op = str(item.get("op", "")).strip().lower()
    value = item.get("value")
    many = op in OPERATORS and OPERATORS[op][1] > 1
    return str(item.get("field", "")).strip(), op, value if many and isinstance(value, list) else [value]


def compile_filter(spec: Any) -> Column | None:
    """The condition of a specification `{"logic", "filters": [{"field", "op", "value"}]}`; None for no filters.

    Mail columns are text, and so are the values they are compared with.
    """
    for problem in _problems(spec):
        raise ValueError(problem)
    conditions = []
    for field, op, values in map(_parts, spec.get("filters", [])):
        raw = [str(v) for v in values]
        conditions.append(OPERATORS[op][2](F.col(field), [F.lit(v) for v in raw], raw))
    return JOINED[str(spec.get("logic", "and")).lower()](conditions) if conditions else None


def apply_filter(df: DataFrame, spec: Any) -> DataFrame:
    condition = compile_filter(spec)
    return df if condition is None else df.where(condition)


def filtered_search(mail: DataFrame, spec: Any, limit: int = C.FILTERED_RESULTS) -> DataFrame:
    """The newest mails that pass the specification."""
    columns = ["no", "deliverytime", "subject", "sendername", "company_name", C.CASES]
    return apply_filter(mail, spec).select(*columns).orderBy(*newest_first()).limit(limit)


def match_saved(df: DataFrame, specs: dict[str, Any], key: str = "no") -> DataFrame:
    """(spec, key) of every saved specification that a row passes: one scan for all specifications."""
    hits = []
    for name, spec in specs.items():
        condition = compile_filter(spec)
        hits.append(F.lit(name) if condition is None else F.when(condition, F.lit(name)))
    return (df.select(F.col(key), F.explode(F.array(*hits)).alias("spec"))
            .where(F.col("spec").isNotNull()).select("spec", key))
