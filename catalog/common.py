"""Input views of the registered queries, written once for Spark and for the SQL oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mailsift import constants as C
from mailsift.operators import bm25, filters, ngrams
from mailsift.operators.containment import text_fields
from mailsift.session import bounded_reads
from mailsift.sources.tables import normalise
from mailsift.storage import new_path, store

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

WIDE_TABLES = ("documents", "pages")

# A mail table over `documents`, `events` and `orders` with the dirty values of a spreadsheet export.
MAIL_RAW = """
SELECT concat(CAST(d.doc_id AS STRING), CASE WHEN d.doc_id % 4 = 0 THEN '.0' ELSE '' END) AS no,
       split_part(d.text, chr(10), 1) AS subject,
       concat('user', CAST(e.user_id AS STRING)) AS sendername,
       concat('user', CAST(e.user_id AS STRING), '@', d.source, '.example.com') AS senderemail,
       CASE WHEN d.doc_id % 13 = 0 THEN 'None' ELSE concat('desk@', d.lang, '.example.org; Ops Team') END
           AS recipientto,
       d.text AS plaintextbody,
       concat('CASE-', lpad(CAST(d.doc_id % 97 AS STRING), 4, '0')) AS hvdc_cases,
       CASE WHEN d.doc_id % 7 = 0 THEN 'None' WHEN d.doc_id % 7 = 1 THEN '  ' ELSE d.source END AS company_name,
       CASE WHEN d.doc_id % 6 = 0 THEN '' ELSE e.event_type END AS stage,
       CASE d.doc_id % 5 WHEN 0 THEN upper(d.lang) WHEN 1 THEN concat(' ', d.lang, ' ')
                         WHEN 2 THEN 'None' WHEN 3 THEN NULL ELSE d.lang END AS site,
       CASE d.doc_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'German' WHEN 2 THEN 'Depot 9' ELSE NULL END AS sites,
       CASE d.doc_id % 10 WHEN 0 THEN 'unknown' WHEN 5 THEN d.lang ELSE NULL END AS primary_site,
       concat(CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS STRING),
              CASE WHEN d.doc_id % 3 = 0 THEN '.0' ELSE '' END) AS month,
       CASE WHEN d.doc_id % 11 = 0 THEN 'unknown'
            ELSE concat(substring(CAST(o.o_orderdate AS STRING), 1, 10), ' 00:00:00') END AS deliverytime,
       concat('CASE-', lpad(CAST(d.doc_id % 97 AS STRING), 4, '0')) AS primary_case,
       concat('LPO-', CAST(1000 + d.doc_id % 350 AS STRING)) AS lpo_numbers,
       substring(md5(CAST(d.doc_id AS STRING)), 1, 12) AS linkkey,
       concat('row/', CAST(d.doc_id * 7 AS STRING)) AS rowkey
FROM {documents} d
JOIN {events} e ON e.event_id = d.doc_id
JOIN {orders} o ON o.o_orderkey = d.doc_id
"""

QUERIES = "SELECT item_id AS query_id, text AS query_text FROM {benchmark}"

# Every fifth query names a case, an order, a mail id or a row key next to its text.
IDENTIFIER_QUERIES = """
SELECT item_id AS query_id,
       CASE item_id % 5
            WHEN 0 THEN concat('CASE-', lpad(CAST(item_id % 97 AS STRING), 4, '0'), ' ', text)
            WHEN 1 THEN concat(text, ' lpo ', CAST(1000 + item_id AS STRING), '.')
            WHEN 2 THEN concat('mail ', CAST(item_id * 3 AS STRING), ' or row/', CAST(item_id * 70 AS STRING))
            WHEN 3 THEN concat('Ref (LPO1', CAST(100 + item_id AS STRING), '), 2025 / 202503; MRR-2025-0',
                               CAST(item_id AS STRING))
            ELSE text END AS query_text
FROM {benchmark}
"""

# Every query names a case next to its text.
CASE_QUERIES = """
SELECT item_id AS query_id, concat('CASE-', lpad(CAST(item_id % 97 AS STRING), 4, '0'), ' ', text) AS query_text
FROM {benchmark}
"""

# Two of three queries hold a Hangul word, which routes them to the glossary.
MIXED_QUERIES = """
SELECT item_id AS query_id,
       CASE item_id % 3 WHEN 0 THEN concat('통관 ', text) WHEN 1 THEN concat(text, ' 지연') ELSE text END
           AS query_text
FROM {benchmark}
"""

SITES = {
    "EN": ("ENGLISH", ("EN", "ENGLISH")),
    "FR": ("FRENCH", ("FR", "FRENCH")),
    "DE": ("GERMAN", ("DE", "GERMAN")),
    "ES": ("SPANISH", ("ES", "SPANISH")),
}
# Words of the fixture texts in the roles of the domain words.
GLOSSARY = {
    "통관": (("통관", "onthsh", "thwhesou"), ("heonha", "erheses")),
    "지연": (("지연", "threresh", "eauxique"), ("inthwh", "thndessh", "thwhing")),
    "선적": (("선적", "schver"), ("eauouan", "thionan")),
}
SYNONYMS = {"erth": ("erth", "erthndly"), "onthsh": ("ONTHSH", "onsh"), "통관": ("heonha", "thndnd")}
ISSUES = {
    "Thing": ("thing", "inging"), "지연": ("eaux", "지연"), "Sch": ("sch", "ung"), "Tion": ("tion", " of ", " de "),
}
DECISIONS = ("whing", "reanre", "case-0001", "승인", "ment")
ENTITIES = {
    "Site": r"\b(?:en|und|les)\b",
    "Vendor": r"\b(?:src1|onthsh|Thing|ouer)\b",
    "Issue": r"\b(?:hold|delay|ingen|eaux)\b",
    "Ref": r"\b(?:CASE|LPO|MRR)[-:/\s]?[A-Z0-9][A-Z0-9\-/]{4,}\b|\b\d{8,}\b",
}

_mails: dict[tuple[str, str], str] = {}
_indexes: dict[tuple[str, str], str] = {}
_grams: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in WIDE_TABLES and df.rdd.getNumPartitions() < cores:
        # A table in fewer splits than cores would run on a few of them only; a stored mail table has many files.
        df = df.repartition(cores)
    return df


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view text over the tables of one directory."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


def mail_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MAIL_RAW)


def fresh_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail table, cleaned from its source tables."""
    return normalise(mail_raw(spark, sf_dir))


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored mail table, loaded once per session and directory."""
    bounded_reads(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _mails:
        _mails[key] = new_path(spark, "mail")
        store(fresh_mail(spark, sf_dir), _mails[key])
    return spark.read.parquet(_mails[key])


def index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The stored index of the mail table, written once per session and directory."""
    bounded_reads(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = new_path(spark, "index")
        built = bm25.build_index(mail(spark, sf_dir))
        bm25.write_index(built, path, buckets=8)
        bm25.release(built)
        _indexes[key] = path
    return bm25.read_index(spark, _indexes[key])


def grams(spark: SparkSession, sf_dir: str) -> ngrams.GramIndex:
    """The stored 3-gram index of the mail fields that identifiers and substrings are looked up in."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _grams:
        path = new_path(spark, "grams")
        ngrams.write_grams(text_fields(mail(spark, sf_dir), "no", C.EXACT_FIELDS), path, buckets=8, parts=8)
        _grams[key] = path
    return ngrams.read_grams(spark, _grams[key])


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mails that the filters of the search page leave: by month, stage and sender."""
    months = [f"{year}{month:02d}" for year in range(1993, 1997) for month in range(1, 13)]
    return filters.search_filter(mail(spark, sf_dir), months=months, stages=["click", "view"], sender="@src1").select("no")


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, doubles to six places, so that both engines print the same values."""
    def clean(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c.cast("double"), 6) + 0.0).alias(field.name)
        return c

    return df.select([clean(f) for f in df.schema.fields])


# --- parts of the SQL oracle -------------------------------------------------------------------------------

def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_view(text: str) -> str:
    return reduce(lambda s, t: s.replace("{" + t + "}", t), TABLES, text)


MAIL_COLUMNS = ("no subject sendername senderemail recipientto plaintextbody hvdc_cases company_name stage site sites "
                "primary_site month deliverytime primary_case lpo_numbers linkkey rowkey").split()


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _norm_sql(c: str) -> str:
    value = strip_sql(c)
    value = rf"regexp_replace({value}, '\.0+$', '')" if c in ("no", "month") else c
    return rf"CASE WHEN regexp_full_match({c}, '(?i)\s*(none|nan|null)?\s*') THEN NULL ELSE {value} END AS {c}"


MAIL_SQL = (f"mail_raw AS ({sql_view(MAIL_RAW)}),\nmail AS (SELECT "
            + ", ".join(_norm_sql(c) for c in MAIL_COLUMNS) + " FROM mail_raw)")

HELD_SQL = """held AS (SELECT * FROM mail WHERE month BETWEEN '199301' AND '199612' AND stage IN ('click', 'view')
    AND senderemail ILIKE '%@src1%')"""

TIME_SQL = "try_cast(deliverytime AS TIMESTAMP)"
NEWEST_SQL = f"{TIME_SQL} DESC NULLS LAST, try_cast(no AS BIGINT) DESC NULLS LAST"


def tokens_sql(c: str, stop: bool = True) -> str:
    words = quoted(["", *C.STOP_WORDS]) if stop else "''"
    return (f"list_filter(string_split_regex(strip_accents(lower({c})), '[^a-z]+'), "
            f"lambda w: w NOT IN ({words}))")


def stem_sql(source: str, prefix: str) -> str:
    """CTEs `{prefix}_stem` (raw, term): the English stems of the distinct words `raw` of a relation."""
    from mailsift.functions import stem as S

    def extract(pattern, group=0, c="w"):
        return f"regexp_extract({c}, '{pattern}', {group})"

    def case(table, c):
        return "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"

    def ending(table):
        return extract("(" + "|".join(sorted(table, key=len, reverse=True)) + ")$")

    r1 = "^(gener|commun|arsen|.*?[aeiouy][^aeiouy])"
    r2 = "^.*?[aeiouy][^aeiouy]"
    short = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
    steps = [
        f"SELECT raw, regexp_replace(raw, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT raw FROM {source})",
        f"SELECT raw, w, CASE WHEN {extract(r1)} = '' THEN len(w) ELSE len({extract(r1)}) END AS r1 FROM {{}}",
        f"SELECT raw, w, r1, r1 + CASE WHEN {extract(r2, c='w[r1+1:]')} = '' THEN len(w) "
        f"ELSE len({extract(r2, c='w[r1+1:]')}) END AS r2 FROM {{}}",
        f"SELECT *, {extract('(sses|ied|ies|us|ss|s)$')} AS e FROM {{}}",
        "SELECT raw, r1, r2, CASE WHEN e = 'sses' THEN w[:-3] WHEN e IN ('ied', 'ies') THEN "
        "CASE WHEN len(w) > 4 THEN w[:-3] ELSE w[:-2] END "
        "WHEN e = 's' AND regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END AS w FROM {}",
        f"SELECT *, w AS kept, w IN ({quoted(S.LEFT_ALONE)}) AS stop, "
        f"{extract('(eedly|eed|ingly|ing|edly|ed)$')} AS e FROM {{}}",
        "SELECT *, left(w, len(w) - len(e)) AS cut FROM {}",
        f"""SELECT raw, r1, r2, kept, stop, CASE
              WHEN e IN ('eed', 'eedly') THEN CASE WHEN len(cut) >= r1 THEN cut || 'ee' ELSE w END
              WHEN e <> '' AND regexp_matches(cut, '[aeiouy]') THEN CASE
                  WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e'
                  WHEN regexp_matches(cut, '{"(" + "|".join(S.DOUBLES) + ")$"}') THEN left(cut, len(cut) - 1)
                  WHEN len(cut) <= r1 AND regexp_matches(cut, '{short}') THEN cut || 'e' ELSE cut END
              ELSE w END AS w FROM {{}}""",
        "SELECT raw, r1, r2, kept, stop, regexp_replace(w, '(.[^aeiouy])[yY]$', '\\1i') AS w FROM {}",
    ]
    rules = [
        (S.STEP_2, "r1", "CASE WHEN e = 'ogi' THEN right(b, 1) = 'l' "
                         "WHEN e = 'li' THEN regexp_matches(b, '[cdeghkmnrt]$') ELSE true END"),
        (S.STEP_3, "r1", "(e <> 'ative' OR len(b) >= r2)"),
        (S.STEP_4, "r2", "(e <> 'ion' OR regexp_matches(b, '[st]$'))"),
    ]
    for suffixes, region, allowed in rules:
        steps += [
            f"SELECT raw, r1, r2, kept, stop, w, {ending(suffixes)} AS e FROM {{}}",
            "SELECT *, left(w, len(w) - len(e)) AS b FROM {}",
            f"SELECT raw, r1, r2, kept, stop, CASE WHEN e <> '' AND len(b) >= {region} AND {allowed} "
            f"THEN b || {case(suffixes, 'e')} ELSE w END AS w FROM {{}}",
        ]
    steps += [
        "SELECT *, left(w, len(w) - 1) AS cut FROM {}",
        f"""SELECT raw, kept, stop, CASE
              WHEN right(w, 1) = 'e' AND (len(cut) >= r2 OR (len(cut) >= r1 AND NOT regexp_matches(cut, '{short}')))
                  THEN cut
              WHEN right(w, 2) = 'll' AND len(cut) >= r2 THEN cut ELSE w END AS w FROM {{}}""",
        f"""SELECT raw, CASE WHEN len(raw) <= 2 THEN raw ELSE coalesce({case(S.IRREGULAR, 'raw')},
              replace(CASE WHEN stop THEN kept ELSE w END, 'Y', 'y')) END AS term FROM {{}}""",
    ]
    parts, last = [], ""
    for i, step in enumerate(steps):
        name = f"{prefix}_stem" if i == len(steps) - 1 else f"{prefix}_s{i}"
        parts.append(f"{name} AS ({step.replace('{}', last)})")
        last = name
    return ",\n".join(parts)


INDEX_SQL = ",\n".join([
    MAIL_SQL,
    f"mail_tokens AS (SELECT no, {tokens_sql('concat_ws(chr(32), ' + ', '.join(C.INDEX_FIELDS) + ')')} AS tokens "
    "FROM mail)",
    "docs AS (SELECT no, len(tokens) AS length FROM mail_tokens)",
    "mail_words AS (SELECT no, len(tokens) AS length, unnest(tokens) AS raw FROM mail_tokens)",
    stem_sql("mail_words", "mw"),
    "postings AS (SELECT s.term, w.no, w.length, count(*) AS tf FROM mail_words w JOIN mw_stem s USING (raw) "
    "GROUP BY s.term, w.no, w.length)",
    "terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term)",
    "totals AS (SELECT count(*) AS n, avg(length) AS mean FROM docs)",
])


def bm25_sql(queries: str, name: str, suffix: str = "") -> str:
    """CTEs ending in `{name}` (query_id, no, bm25_score) for a relation (query_id, query_text)."""
    p = f"{name}_w"
    return ",\n".join([
        f"{p} AS (SELECT query_id, unnest({tokens_sql('query_text')}) AS raw FROM {queries})",
        stem_sql(p, p),
        f"{name}_terms AS (SELECT DISTINCT query_id, term FROM {p} JOIN {p}_stem USING (raw))",
        f"""{name} AS (SELECT q.query_id, p.no, round(sum(log10((t.n - d.df + 0.5) / (d.df + 0.5) + 1)
              * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.length / t.mean))), 9) AS bm25_score
            FROM {name}_terms q JOIN postings p USING (term) JOIN terms d USING (term), totals t
            GROUP BY q.query_id, p.no)""",
    ])


def top_sql(source: str, order: str, k: int, columns: str = "*", partition: str = "query_id",
            rank: str = "position") -> str:
    return (f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS {rank} "
            f"FROM {source}) WHERE {rank} <= {k}")
