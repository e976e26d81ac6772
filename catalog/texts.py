"""Identifiers, masks, snippets, entities, labels and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions import chunking, entities, text
from mailsift.functions.clean import text_or_empty
from mailsift.operators import bm25
from .common import (DECISIONS, ENTITIES, IDENTIFIER_QUERIES, INDEX_SQL, ISSUES, MAIL_SQL, QUERIES, bm25_sql, index, mail,
                     quoted, sql_view, strip_sql, table, tidy, top_sql, view)
from .reports import issue_sql
from .text_search import TERM_SQL, distinct_sql


def compact_ids(spark, sf_dir):
    return mail(spark, sf_dir).select("no", *[text.compact(F.col(c)).alias(c) for c in (C.CASES, "lpo_numbers", "rowkey",
                                                                                      "subject")])


def code_variants(spark, sf_dir):
    q = view(spark, sf_dir, IDENTIFIER_QUERIES)
    return q.select("query_id", F.array_join(text.code_variants(F.col("query_text")), "|").alias("variants"))


def code_variants_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(text.code_variants(F.col("text")), "|").alias("variants"))


def identifier_terms(spark, sf_dir):
    q = view(spark, sf_dir, IDENTIFIER_QUERIES)
    return q.select("query_id", F.array_join(text.identifier_terms(F.col("query_text")), "|").alias("terms"))


def mask_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.mask_text(F.col("text")).alias("masked"))


def mask_addresses(spark, sf_dir):
    listed = F.concat(F.col("senderemail"), F.lit("; "), F.col("sendername"), F.lit(", "),
                      text_or_empty(F.col("recipientto")))
    return mail(spark, sf_dir).select("no", text.mask_addresses(listed).alias("masked"))


def snippets(spark, sf_dir):
    q = view(spark, sf_dir, QUERIES).withColumn("terms", text.search_terms(F.col("query_text")))
    hits = bm25.search(index(spark, sf_dir), q, 5).select("query_id", "no")
    rows = hits.join(mail(spark, sf_dir).select("no", "plaintextbody"), "no").join(q, "query_id")
    return rows.select("query_id", "no", text.snippet(F.col("plaintextbody"), F.col("terms")).alias("snippet"))


ENTITY_TEXT = ("subject", "sendername", "company_name", "site", "stage", C.CASES, "lpo_numbers", "plaintextbody")


def _entity_text():
    return F.concat_ws(" ", *[F.col(c) for c in ENTITY_TEXT])


def entity_values(spark, sf_dir):
    found = entities.entity_map(_entity_text(), ENTITIES)
    rows = mail(spark, sf_dir).select("no", F.explode_outer(found).alias("tag", "values"))
    return tidy(rows.select("no", "tag", F.posexplode_outer("values").alias("position", "value")).where(
        F.col("value").isNotNull()))


def entity_chips(spark, sf_dir):
    header = entities.entity_map(F.concat_ws(" ", "subject", "sendername", C.CASES), ENTITIES)
    merged = entities.merge_entities([header, entities.entity_map(_entity_text(), ENTITIES)], tuple(ENTITIES))
    return mail(spark, sf_dir).select("no", entities.chip_text(merged).alias("chips"))


def domain_entities(spark, sf_dir):
    """The default patterns over all documents and page texts."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"),
                                                 F.col("html").alias("text"))
    both = docs.unionByName(pages)
    return both.select("key", entities.chip_text(entities.entity_map(F.col("text"))).alias("chips"))


def issue_label(spark, sf_dir):
    return mail(spark, sf_dir).select("no", entities.issue_label(F.col("subject"), F.col(C.CASES), ISSUES)
                                      .alias("issue_type"))


def decision_signal(spark, sf_dir):
    return mail(spark, sf_dir).select("no", entities.decision_signal(F.col("subject"), F.col(C.CASES), DECISIONS)
                                      .alias("signal"))


def chunk_documents(spark, sf_dir):
    return chunking.chunk_table(mail(spark, sf_dir))


def chunk_limited(spark, sf_dir):
    """The chunk table with the fixed number of body chunks per mail."""
    return chunking.chunk_table(mail(spark, sf_dir), max_chunks=C.MAX_BODY_CHUNKS).select("no", "chunk_id", "section")


# --- SQL -----------------------------------------------------------------------------------------------------

EDGE = r"[ ,.;:()\[\]{}]+"


def edges_sql(c):
    return rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^{EDGE}|{EDGE}$', '', 'g')"


def compact_sql(c):
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def marked_sql(c):
    """Text with a mark before and after every word, because `\\b` of this engine knows ASCII letters only."""
    return rf"regexp_replace({c}, '([\pL\pN_]+)', concat(chr(1), '\1', chr(2)), 'g')"


def unmarked_sql(c):
    return rf"regexp_replace({c}, '[\x01\x02]', '', 'g')"


CODE_MARKED = r"\x01([A-Za-z]{2,10})[-_/\s\x01\x02]*([0-9]{2,6})\x02"


def variants_sql(c):
    """Code spellings of a text, duplicates and all."""
    m = marked_sql(c)
    parts = [f"regexp_extract_all({m}, '{CODE_MARKED}', {g})" for g in (0, 1, 2)]
    spelled = [edges_sql(unmarked_sql("z[1]"))] + [f"z[2] || '{s}' || z[3]" for s in ("-", "/", "_", " ", "")]
    return (f"list_filter(flatten(list_transform(list_zip({', '.join(parts)}), lambda z: [{', '.join(spelled)}])), "
            "lambda v: v <> '')")


def all_variants_sql(c):
    """A text, its code spellings, and the compact form of each."""
    t = edges_sql(c)
    return (f"list_filter(flatten(list_transform(list_concat([{t}], {variants_sql(t)}), "
            f"lambda v: [v, {compact_sql('v')}])), lambda v: v <> '')")


MARKED_PATTERNS = (
    r"\x01[A-Za-z0-9]{2,}(?:\x02?[-_/]\x01?[A-Za-z0-9]+)+\x02",
    r"\x01[A-Za-z]{1,10}\d(?:[\x01\x02]?[A-Za-z0-9/-]){3,}[\x01\x02]",
    rf"(?i)\x01(?:{C.REF_PREFIX})\x02?[-:/\s]?\x01?[A-Z0-9](?:[\x01\x02]?[A-Z0-9\-/]){{4,}}[\x01\x02]",
)


def identifier_ctes(source, name):
    """CTEs ending in `{name}` (query_id, query_text, terms)."""
    clean = strip_sql("query_text")
    found = ", ".join(
        f"list_transform(regexp_extract_all({marked_sql('t')}, '{p}'), lambda x: {unmarked_sql('x')})"
        for p in MARKED_PATTERNS)
    numbers = rf"regexp_extract_all({marked_sql('t')}, '\x01\d{{4,}}\x02')"
    return f"""
    {name}_a AS (SELECT query_id, query_text, {clean} AS t FROM {source}),
    {name}_b AS (SELECT *, {variants_sql('t')} AS codes, {TERM_SQL.format('t')} AS words FROM {name}_a),
    {name}_c AS (SELECT query_id, query_text, flatten([codes,
        CASE WHEN len(codes) > 0 THEN [] ELSE list_transform({numbers}, lambda x: {unmarked_sql('x')}) END, {found},
        list_filter(words, lambda w: regexp_matches(w, '[0-9/-]'))]) AS seeds FROM {name}_b),
    {name}_d AS (SELECT query_id, query_text, flatten(list_transform(seeds, lambda s: {all_variants_sql('s')})) AS v
                 FROM {name}_c),
    {name} AS (SELECT query_id, query_text, {distinct_sql('v')}[1:16] AS terms FROM {name}_d)"""


def mask_sql(c):
    """The four masks in their order."""
    masked = c
    for pattern, tag in C.MASKS:
        masked = f"regexp_replace({masked}, '(?i){pattern}', '{tag}', 'g')"
    return masked


SENTENCES_SQL = rf"""list_filter(string_split(regexp_replace({strip_sql(r"regexp_replace({0}, '\s+', ' ', 'g')")},
    '([.!?。！？])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: s <> '')"""


def names_sql(text_, term):
    return (f"(contains(lower({text_}), lower({term})) OR ({compact_sql(term)} <> '' AND "
            f"contains({compact_sql(text_)}, {compact_sql(term)})))")


ENTITY_MARKED = {
    "Site": r"\x01(?:en|und|les)\x02",
    "Vendor": r"\x01(?:src1|onthsh|Thing|ouer)\x02",
    "Issue": r"\x01(?:hold|delay|ingen|eaux)\x02",
    "Ref": r"\x01(?:CASE|LPO|MRR)\x02?[-:/\s]?\x01?[A-Z0-9](?:[\x01\x02]?[A-Z0-9\-/]){4,}[\x01\x02]|\x01\d{8,}\x02",
}


def entity_ctes(source, text_, name):
    """CTEs ending in `{name}` (no, tag, position, value)."""
    parts = []
    for tag, pattern in ENTITY_MARKED.items():
        values = f"list_transform(regexp_extract_all(m, '(?i){pattern}'), lambda x: {unmarked_sql('x')})"
        if tag == "Ref":
            values = f"list_transform({values}, lambda x: {mask_sql('x')})"
        parts.append(f"SELECT no, '{tag}' AS tag, {values} AS v FROM {name}_m")
    return f"""{name}_m AS (SELECT no, {marked_sql(text_)} AS m FROM {source}),
    {name}_v AS ({" UNION ALL ".join(parts)}),
    {name}_d AS (SELECT no, tag, {distinct_sql('v')}[1:6] AS v FROM {name}_v),
    {name} AS (SELECT no, tag, unnest(range(len(v))) AS position, unnest(v) AS value FROM {name}_d)"""


ENTITY_TEXT_SQL = f"concat_ws(' ', {', '.join(ENTITY_TEXT)})"
HEADER_TEXT_SQL = f"concat_ws(' ', subject, sendername, {C.CASES})"
CHIP_CASE = "CASE tag " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(C.CHIP_ORDER)) + " END"

DOMAIN_MARKED = {
    "Site": r"\x01(?:AGI|DAS|MIR|SHU|MOSB)\x02",
    "Vendor": r"\x01(?:DSV|Mammoet|ADNOC|ALS|SCT|Samsung\x02 \x01C\x02&\x01T|HMM|COSCO)\x02",
    "Doc": r"\x01(?:BL|B\x02/\x01L|BOE|DO|MRR|CIPL|FANR|Invoice|Packing\x02 \x01List|Purchase\x02 \x01Order)\x02",
    "Issue": r"\x01(?:DEM|DET|demurrage|detention|claim|delay|delayed|hold|customs\x02 \x01clearance"
             r"|통관|지연|클레임|디머리지|디텐션|승인|보류)\x02",
    "Ref": rf"\x01(?:{C.REF_PREFIX})\x02?[-:/\s]?\x01?[A-Z0-9](?:[\x01\x02]?[A-Z0-9\-/]){{4,}}[\x01\x02]|\x01\d{{8,}}\x02",
}


def _domain_chip(tag):
    values = f"list_transform(regexp_extract_all(m, '(?i){DOMAIN_MARKED[tag]}'), lambda x: {unmarked_sql('x')})"
    if tag == "Ref":
        values = f"list_transform({values}, lambda x: {mask_sql('x')})"
    return f"{values} AS {tag.lower()}_v"


DOMAIN_SQL = f"""WITH both_ AS (SELECT 'd' || doc_id AS key, text FROM documents UNION ALL
    SELECT 'p' || page_id, html FROM pages), marked AS (SELECT key, {marked_sql('text')} AS m FROM both_),
    v AS (SELECT key, {", ".join(_domain_chip(t) for t in DOMAIN_MARKED)} FROM marked),
    d AS (SELECT key, {", ".join(distinct_sql(t.lower() + "_v") + f"[1:3] AS {t.lower()}_v" for t in DOMAIN_MARKED)} FROM v)
    SELECT key, array_to_string(list_filter([{", ".join(
        f"CASE WHEN len({t.lower()}_v) > 0 THEN '[{t}: ' || array_to_string({t.lower()}_v, ', ') || ']' END"
        for t in ("Vendor", "Issue", "Site", "Doc", "Ref"))}], lambda x: x IS NOT NULL), ' ') AS chips FROM d"""

BODY = strip_sql("coalesce(plaintextbody, '')")
CHUNK_SQL = rf"""{MAIL_SQL}, bodies AS (SELECT no, {BODY} AS body FROM mail),
    starts AS (SELECT no, body, unnest(CASE WHEN len(body) = 0 THEN [] WHEN len(body) <= 500 THEN [0]
                                       ELSE range(0, len(body), 450) END) AS start FROM bodies),
    chunks AS (SELECT no, 'body_' || (start // 450) AS section, start // 450 AS i,
                      substring(body, start + 1, 500) AS chunk_text FROM starts
               UNION ALL SELECT no, 'header', -1, left(concat_ws(' | ', nullif({strip_sql("coalesce(subject, '')")}, ''),
                   sendername, company_name), 500) FROM mail)"""

ENTRIES = {
    "compact_ids": (compact_ids, f"WITH {MAIL_SQL} SELECT no, " + ", ".join(
        f"{compact_sql(c)} AS {c}" for c in (C.CASES, "lpo_numbers", "rowkey", "subject")) + " FROM mail"),
    "code_variants": (code_variants, f"""WITH q AS ({sql_view(IDENTIFIER_QUERIES)}),
        v AS (SELECT query_id, {variants_sql('query_text')} AS v FROM q)
        SELECT query_id, array_to_string({distinct_sql('v')}, '|') AS variants FROM v"""),
    "code_variants_documents": (code_variants_documents, f"""WITH v AS (SELECT doc_id, {variants_sql('text')} AS v
        FROM documents) SELECT doc_id, array_to_string({distinct_sql('v')}, '|') AS variants FROM v"""),
    "identifier_terms": (identifier_terms, f"""WITH q AS ({sql_view(IDENTIFIER_QUERIES)}), {identifier_ctes('q', 'i')}
        SELECT query_id, array_to_string(terms, '|') AS terms FROM i"""),
    "mask_text": (mask_text, f"SELECT doc_id, {mask_sql('text')} AS masked FROM documents"),
    "mask_addresses": (mask_addresses, f"""WITH {MAIL_SQL} SELECT no, left(senderemail, 1) || '****@' ||
        split_part(senderemail, '@', 2) || '; ' || sendername || CASE WHEN recipientto IS NULL THEN ',' ELSE
        ', d****@' || split_part(recipientto, '@', 2) END AS masked FROM mail"""),
    "snippets": (snippets, rf"""WITH {INDEX_SQL}, queries AS ({sql_view(QUERIES)}), {bm25_sql('queries', 'hits')},
        {identifier_ctes('queries', 'i')},
        wanted AS (SELECT query_id, CASE WHEN len(terms) > 0 THEN terms ELSE {distinct_sql('w')} END AS t FROM
                  (SELECT query_id, terms, {TERM_SQL.format('query_text')} AS w FROM i)),
        best AS ({top_sql('hits', 'round(bm25_score, 9) DESC, no', 5, 'query_id, no')}),
        parts AS (SELECT b.query_id, b.no, t.t, {SENTENCES_SQL.replace("{0}", "m.plaintextbody")} AS s
                  FROM best b JOIN mail m USING (no) JOIN wanted t USING (query_id)),
        sentences AS (SELECT query_id, no, t, unnest(s) AS sentence, unnest(range(len(s))) AS idx FROM parts),
        scored AS (SELECT *, 2.0 * len(list_filter(t, lambda x: {names_sql('sentence', 'x')})) AS hits FROM sentences),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, no ORDER BY
                   hits + greatest(0.0, 2.0 - idx * 0.1) DESC, idx) AS r FROM scored WHERE hits > 0),
        joined AS (SELECT query_id, no, any_value(t) AS t, string_agg(sentence, ' ' ORDER BY r) AS s FROM ranked
                   WHERE r <= 3 GROUP BY query_id, no)
        SELECT b.query_id, b.no, coalesce(list_reduce(list_concat([{mask_sql('s')}], t), lambda acc, x: regexp_replace(acc,
            '(?i)(' || x || ')', '**\1**', 'g')), '') AS snippet FROM best b LEFT JOIN joined j USING (query_id, no)"""),
    "entities": (entity_values, f"WITH {MAIL_SQL}, {entity_ctes('mail', ENTITY_TEXT_SQL, 'e')} "
                                "SELECT no, tag, position, value FROM e"),
    "entity_chips": (entity_chips, f"""WITH {MAIL_SQL}, {entity_ctes('mail', HEADER_TEXT_SQL, 'h')},
        {entity_ctes('mail', ENTITY_TEXT_SQL, 'e')},
        merged AS (SELECT no, tag, value, min(o) AS o FROM (SELECT no, tag, value, position AS o FROM h
                   UNION ALL SELECT no, tag, value, position + 100 FROM e) GROUP BY no, tag, value),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY no, tag ORDER BY o) AS r FROM merged),
        chips AS (SELECT no, tag, '[' || tag || ': ' || string_agg(value, ', ' ORDER BY r) || ']' AS chip FROM ranked
                  WHERE r <= 3 GROUP BY no, tag)
        SELECT m.no, coalesce(string_agg(c.chip, ' ' ORDER BY {CHIP_CASE}), '') AS chips FROM mail m
        LEFT JOIN chips c USING (no) GROUP BY m.no"""),
    "domain_entities": (domain_entities, DOMAIN_SQL),
    "issue_label": (issue_label, f"WITH {MAIL_SQL} SELECT no, {issue_sql()} AS issue_type FROM mail"),
    "decision_signal": (decision_signal, f"""WITH {MAIL_SQL}, t AS (SELECT no, lower(concat(coalesce(subject, ''), ' ',
        coalesce(hvdc_cases, ''))) AS t FROM mail) SELECT no, CASE WHEN {" OR ".join(
            f"contains(t, '{w}')" for w in DECISIONS)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS signal FROM t"""),
    "chunk_documents": (chunk_documents, f"""WITH {CHUNK_SQL} SELECT no, no || '_' || section AS chunk_id, section,
        chunk_text FROM chunks"""),
    "chunk_limited": (chunk_limited, f"""WITH {CHUNK_SQL} SELECT no, no || '_' || section AS chunk_id, section
        FROM chunks WHERE i < 10"""),
}
