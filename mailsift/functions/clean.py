"""Column expressions that turn raw export text into clean values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import constants as C


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (SQL `trim` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def blank_to_null(c: Column) -> Column:
    """NULL for blank text; other text is stripped."""
    return F.nullif(strip(c), F.lit(""))


def real_null(c: Column, sentinels=C.SENTINELS) -> Column:
    """NULL where the text is blank or one of the words that stand for a missing value."""
    words = "|".join(sentinels)
    return F.when(~c.rlike(rf"(?iU)^\s*(?:{words})?\s*$"), c)


def id_value(c: Column) -> Column:
    """Display form of an id: stripped, one trailing `.0` removed, empty for NULL."""
    return F.regexp_replace(strip(text_or_empty(c)), r"\.0$", "")


def id_key(c: Column) -> Column:
    """Join form of an id: stripped, a trailing `.0`, `.00`, ... removed."""
    return F.regexp_replace(strip(c), r"\.0+$", "")


def id_number(c: Column) -> Column:
    return id_key(c).try_cast("bigint")


def month_label(c: Column) -> Column:
    """`YYYYMM` as `YYYY-MM`; other text as it is."""
    month = F.regexp_replace(strip(text_or_empty(c)), r"\.0", "")
    return F.regexp_replace(month, r"^(\d{4})(\d{2})$", "$1-$2")


def timestamp(c: Column) -> Column:
    return c.try_cast("timestamp")


def timestamp_label(c: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` where the text is a time, else the stripped text, empty for NULL."""
    return F.coalesce(F.date_format(timestamp(c), "yyyy-MM-dd HH:mm:ss"), strip(c), F.lit(""))


def site_key(c: Column) -> Column:
    """Case-folded site text; NULL for blank text and for words that mean 'no site'."""
    key = F.lower(strip(c))
    return F.when(~key.isin("", *C.SITE_BLANKS), key)


def site_code(c: Column, sites=C.SITES) -> Column:
    """The code of a site alias, NULL for text that is no alias."""
    pairs = {alias.lower(): code for code, (_, aliases) in sites.items() for alias in aliases}
    if not pairs:
        return F.lit(None).cast("string")
    lookup = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return lookup[site_key(c)]


def site_value(c: Column, sites=C.SITES) -> Column:
    """The code where the text is an alias, else the stripped text; NULL for 'no site'."""
    return F.coalesce(site_code(c, sites), F.when(site_key(c).isNotNull(), strip(c)))


def first_site(columns: list[Column], sites=C.SITES) -> Column:
    return F.coalesce(*[site_value(c, sites) for c in columns])


def escape_like(text: str) -> str:
    """User text for use inside a LIKE pattern: `%`, `_` and `\\` stand for themselves."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_text(c: Column, text: str) -> Column:
    return c.ilike(f"%{escape_like(text)}%")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def mail_display_columns(present: list[str]) -> dict[str, Column]:
    """Display form of the id, month, time and site columns that a table has."""
    forms = {"month": month_label, "deliverytime": timestamp_label, "creationtime": timestamp_label,
             "site": _site_text, "sites": _site_text, "primary_site": _site_text}
    return {name: form(F.col(name)) for name, form in forms.items() if name in present}


def _site_text(c: Column) -> Column:
    return F.coalesce(site_value(c), F.lit(""))
