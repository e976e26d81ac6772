"""Tokens, index, BM25 and query expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions import expand, text
from mailsift.functions.stem import stem_tokens
from mailsift.operators import bilingual, block_bounds, bm25, generations
from mailsift.storage import new_path
from .common import (GLOSSARY, HELD_SQL, IDENTIFIER_QUERIES, INDEX_SQL, MAIL_SQL, MIXED_QUERIES, NEWEST_SQL, QUERIES, SYNONYMS,
                     bm25_sql, grams, held, index, mail, quoted, sql_view, stem_sql, table, tidy, tokens_sql, top_sql, view)


def tokenize_terms(spark, sf_dir):
    tokens = text.index_tokens(F.col("text"))
    return tidy(table(spark, sf_dir, "documents").select(
        "doc_id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("terms")))


def stem_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(text.index_tokens(F.col("text")).alias("raw"))
    pairs = stem_tokens(docs.withColumn("term", F.col("raw")), "term")
    return pairs.select(F.explode_outer(F.arrays_zip("raw", "term")).alias("p")).select("p.raw", "p.term").where(
        F.col("raw").isNotNull()).distinct()


def bm25_index(spark, sf_dir):
    return bm25.build_index(mail(spark, sf_dir)).postings


def bm25_stats(spark, sf_dir):
    built = bm25.build_index(mail(spark, sf_dir))
    n, mean = built.totals()
    return tidy(built.terms.select("term", "df", F.lit(n).cast("bigint").alias("n_docs"),
                                   F.lit(mean).alias("mean_length")))


def bm25_unstemmed(spark, sf_dir):
    built = bm25.build_index(mail(spark, sf_dir), stem=False)
    return built.terms


def bm25_incremental(spark, sf_dir):
    """An index of the mails with labels, extended by the whole mail table."""
    m = mail(spark, sf_dir)
    labelled = m.join(table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("no")), "no",
                      "left_semi")
    grown = bm25.extend_index(bm25.build_index(labelled), m)
    n, mean = grown.totals()
    return tidy(grown.terms.select("term", "df", F.lit(n).cast("bigint").alias("n_docs"),
                                   F.lit(mean).alias("mean_length")))


def bm25_search(spark, sf_dir):
    found = bm25.search(index(spark, sf_dir), view(spark, sf_dir, QUERIES), 10)
    return tidy(found.select("query_id", "no", "bm25_score", "position"))


def _blocks(spark, sf_dir):
    path = new_path(spark, "blocks")
    block_bounds.write_blocks(index(spark, sf_dir), path, buckets=8, block_docs=32)
    return block_bounds.read_blocks(spark, path)


def bm25_blocks(spark, sf_dir):
    """The BM25 search by upper bounds of blocks of mails."""
    found = block_bounds.search_blocks(_blocks(spark, sf_dir), view(spark, sf_dir, QUERIES), 10)
    return tidy(found.select("query_id", "no", "bm25_score", "position"))


def _updated(spark, sf_dir):
    """The path of an index that reaches the mail table by updates: stale, missing and surplus mails at first."""
    m, path = mail(spark, sf_dir), new_path(spark, "generations")
    number = F.expr("cast(no as bigint)")
    stale = m.where(number % 3 != 0).withColumn("subject", F.when(number % 5 == 1, "stale words").otherwise(F.col("subject")))
    surplus = m.where(number % 11 == 0).withColumn("no", F.concat(F.lit("x"), "no"))
    generations.create(stale.unionByName(surplus), path, buckets=8, parts=8)
    generations.update(spark, path, m.where(number % 5 == 1), m.where(number % 7 == 2))
    generations.update(spark, path, m.where((number % 3 == 0) | (number % 7 == 2)), surplus)
    return path


def bm25_generations(spark, sf_dir):
    """The BM25 search of an index that was updated twice: mails added, replaced, withdrawn and added again."""
    found = bm25.search(generations.read(spark, _updated(spark, sf_dir)), view(spark, sf_dir, QUERIES), 10)
    return tidy(found.select("query_id", "no", "bm25_score", "position"))


def bm25_compacted(spark, sf_dir):
    """Word counts and totals of the updated index after compaction."""
    path = new_path(spark, "compacted")
    generations.compact(spark, _updated(spark, sf_dir), path)
    packed = generations.read(spark, path)
    n, mean = packed.totals()
    return tidy(packed.terms.select("term", "df", F.lit(n).cast("bigint").alias("n_docs"), F.lit(mean).alias("mean_length")))


def filtered_bm25_search(spark, sf_dir):
    found = bm25.search(index(spark, sf_dir), view(spark, sf_dir, QUERIES), 10, held(spark, sf_dir))
    return tidy(found.select("query_id", "no", "bm25_score", "position"))


def filtered_match_count(spark, sf_dir):
    scores = bm25.match_scores(index(spark, sf_dir), view(spark, sf_dir, QUERIES), allowed=held(spark, sf_dir))
    return tidy(bm25.match_counts(scores))


def match_count(spark, sf_dir):
    return bm25.match_counts(bm25.match_scores(index(spark, sf_dir), view(spark, sf_dir, QUERIES)))


def query_terms(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


def route_language(spark, sf_dir):
    return bilingual.route(view(spark, sf_dir, MIXED_QUERIES)).select("query_id", "mode")


def glossary_expand(spark, sf_dir):
    q = view(spark, sf_dir, MIXED_QUERIES)
    return q.select(
        "query_id", F.array_join(expand.variants(F.col("query_text"), GLOSSARY), "|").alias("variants"),
        F.array_join(expand.english_terms(F.col("query_text"), GLOSSARY), "|").alias("english"))


def rewrite_query(spark, sf_dir):
    q = view(spark, sf_dir, MIXED_QUERIES)
    return q.select("query_id", expand.rewrite(F.col("query_text"), GLOSSARY, SYNONYMS).alias("rewritten"),
                    F.array_join(expand.rewrite_terms(F.col("query_text"), GLOSSARY, SYNONYMS, 200), "|").alias("all"))


def bilingual_search(spark, sf_dir):
    q = view(spark, sf_dir, MIXED_QUERIES)
    hangul = q.where(text.has_hangul(F.col("query_text")))
    found = bilingual.bilingual_search(mail(spark, sf_dir), index(spark, sf_dir), hangul, 50, GLOSSARY,
                                       grams=grams(spark, sf_dir))
    return tidy(found.select("query_id", "no", "tier", "bm25_score", "position"))


# Queries that match as words, as parts of words only, or not at all.
HARD_QUERIES = """
SELECT item_id AS query_id,
       CASE item_id % 4 WHEN 0 THEN concat('zzqx', substring(split_part(text, ' ', 2), 2, 20), ' ',
                                            substring(split_part(text, ' ', 3), 2, 20))
                        WHEN 1 THEN concat('qqzz', CAST(item_id AS STRING))
                        WHEN 2 THEN concat('통관 ', split_part(text, ' ', 3))
                        ELSE split_part(text, ' ', 2) END AS query_text
FROM {benchmark}
"""


def fallback_search(spark, sf_dir):
    q = view(spark, sf_dir, HARD_QUERIES)
    first = bm25.match_scores(index(spark, sf_dir), q.withColumn("query_text", F.split_part(
        "query_text", F.lit(" "), F.lit(1))))
    found = bilingual.fallback_search(mail(spark, sf_dir), index(spark, sf_dir), q, first, 20, grams=grams(spark, sf_dir))
    return tidy(found)


def key_decisions(spark, sf_dir):
    found = bilingual.key_decisions(mail(spark, sf_dir), index(spark, sf_dir), "승인 onthsh thionan hold", 10)
    return found.select("no", "deliverytime", "subject")


def distinct_sql(c):
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


TERM_SQL = (r"list_filter(regexp_extract_all({}, '[A-Za-z0-9가-힣][A-Za-z0-9가-힣/\-]+'), lambda w: len(w) > 2 AND "
            f"lower(w) NOT IN ({quoted(C.QUERY_STOP_WORDS)}))")


def hit_sql(key, entry):
    words = dict.fromkeys(w.lower() for w in (key, *entry[0], *entry[1]))
    return "(" + " OR ".join(f"contains(lower(query_text), '{w}')" for w in words) + ")"


def lists_sql(pick):
    return ", ".join(f"CASE WHEN {hit_sql(k, e)} THEN [{quoted(pick(e))}] ELSE [] END" for k, e in GLOSSARY.items())


EXPANDED_SQL = f"""mixed AS ({sql_view(MIXED_QUERIES)}),
    lists AS (SELECT query_id, query_text, flatten([[query_text], {lists_sql(lambda e: e[0])}]) AS v,
                     flatten([{lists_sql(lambda e: e[1])}]) AS e FROM mixed),
    expanded AS (SELECT query_id, query_text, {distinct_sql('v')}[1:8] AS v, {distinct_sql('e')}[1:8] AS e FROM lists)"""

SYNONYM_SQL = ", ".join(f"CASE WHEN contains(lower(query_text), '{w}') THEN [{quoted(s)}] ELSE [] END"
                        for w, s in SYNONYMS.items())

ENTRIES = {
    "tokenize_terms": (tokenize_terms, f"""SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS terms FROM
        (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)"""),
    "stem_terms": (stem_terms, f"""WITH words AS (SELECT unnest({tokens_sql('text')}) AS raw FROM documents),
        {stem_sql('words', 's')} SELECT raw, term FROM s_stem"""),
    "bm25_index": (bm25_index, f"WITH {INDEX_SQL} SELECT term, no, tf, length FROM postings"),
    "bm25_stats": (bm25_stats, f"""WITH {INDEX_SQL} SELECT term, df, n AS n_docs, round(mean, 6) AS mean_length
        FROM terms, totals"""),
    "bm25_unstemmed": (bm25_unstemmed, f"""WITH {INDEX_SQL} SELECT raw AS term, count(DISTINCT no) AS df
        FROM mail_words GROUP BY raw"""),
    "bm25_incremental": (bm25_incremental, f"""WITH {INDEX_SQL} SELECT term, df, n AS n_docs,
        round(mean, 6) AS mean_length FROM terms, totals"""),
    "bm25_search": (bm25_search, f"""WITH {INDEX_SQL}, queries AS ({sql_view(QUERIES)}), {bm25_sql('queries', 'hits')}
        SELECT query_id, no, round(bm25_score, 6) AS bm25_score, position
        FROM ({top_sql('hits', 'round(bm25_score, 9) DESC, no', 10)})"""),
    "bm25_generations": (bm25_generations, f"""WITH {INDEX_SQL}, queries AS ({sql_view(QUERIES)}), {bm25_sql('queries', 'hits')}
        SELECT query_id, no, round(bm25_score, 6) AS bm25_score, position
        FROM ({top_sql('hits', 'round(bm25_score, 9) DESC, no', 10)})"""),
    "bm25_compacted": (bm25_compacted, f"""WITH {INDEX_SQL} SELECT term, df, n AS n_docs, round(mean, 6) AS mean_length
        FROM terms, totals"""),
    "bm25_blocks": (bm25_blocks, f"""WITH {INDEX_SQL}, queries AS ({sql_view(QUERIES)}), {bm25_sql('queries', 'hits')}
        SELECT query_id, no, round(bm25_score, 6) AS bm25_score, position
        FROM ({top_sql('hits', 'round(bm25_score, 9) DESC, no', 10)})"""),
    "filtered_bm25_search": (filtered_bm25_search, f"""WITH {INDEX_SQL}, {HELD_SQL}, queries AS ({sql_view(QUERIES)}),
        {bm25_sql('queries', 'hits')}
        SELECT query_id, no, round(bm25_score, 6) AS bm25_score, position FROM
        ({top_sql('(SELECT * FROM hits WHERE no IN (SELECT no FROM held))', 'round(bm25_score, 9) DESC, no', 10)})"""),
    "filtered_match_count": (filtered_match_count, f"""WITH {INDEX_SQL}, {HELD_SQL}, queries AS ({sql_view(QUERIES)}),
        {bm25_sql('queries', 'hits')} SELECT query_id, count(*) AS matches FROM hits WHERE no IN (SELECT no FROM held)
        GROUP BY query_id"""),
    "match_count": (match_count, f"""WITH {INDEX_SQL}, queries AS ({sql_view(QUERIES)}), {bm25_sql('queries', 'hits')}
        SELECT query_id, count(*) AS matches FROM hits GROUP BY query_id"""),
    "query_terms": (query_terms, f"""SELECT conv_id, turn, array_to_string({distinct_sql('t')}, ' ') AS terms FROM
        (SELECT *, {TERM_SQL.format('text')} AS t FROM conversations)"""),
    "route_language": (route_language, f"""WITH {EXPANDED_SQL} SELECT query_id,
        CASE WHEN NOT regexp_matches(query_text, '[가-힣]') THEN 'bm25' ELSE 'glossary' END AS mode FROM mixed"""),
    "glossary_expand": (glossary_expand, f"""WITH {EXPANDED_SQL} SELECT query_id, array_to_string(v, '|') AS variants,
        array_to_string(e, '|') AS english FROM expanded"""),
    "rewrite_query": (rewrite_query, f"""WITH mixed AS ({sql_view(MIXED_QUERIES)}),
        words AS (SELECT query_id, query_text, {TERM_SQL.format('query_text')} AS w FROM mixed),
        found AS (SELECT query_id, flatten([w, {lists_sql(lambda e: e[1][:3])}, {SYNONYM_SQL}]) AS w FROM words),
        lowered AS (SELECT query_id, w, list_transform(w, lambda x: lower(x)) AS l FROM found),
        firsts AS (SELECT query_id, list_filter(w, lambda x, i: list_position(l, lower(x)) = i) AS w FROM lowered)
        SELECT query_id, array_to_string(w[1:5], ' OR ') AS rewritten, array_to_string(w[1:200], '|') AS "all"
        FROM firsts"""),
    "bilingual_search": (bilingual_search, f"""WITH {INDEX_SQL}, {EXPANDED_SQL},
        hangul AS (SELECT * FROM expanded WHERE regexp_matches(query_text, '[가-힣]')),
        variant AS (SELECT DISTINCT query_id, no FROM (SELECT query_id, lower(unnest(v)) AS term FROM hangul) q
                    JOIN mail m ON contains(lower(m.subject), q.term) OR contains(lower(m.plaintextbody), q.term)),
        english AS (SELECT query_id, array_to_string(e, ' OR ') AS query_text FROM hangul WHERE len(e) > 0),
        {bm25_sql('english', 'hits')},
        found AS (SELECT query_id, no, CASE WHEN v.no IS NULL THEN 1 ELSE 0 END AS tier, bm25_score
                  FROM variant v FULL JOIN hits h USING (query_id, no)),
        tiers AS (SELECT f.query_id, f.no, CASE WHEN v.no IS NULL THEN 1 ELSE 0 END AS tier, f.bm25_score, m.deliverytime
                  FROM found f LEFT JOIN variant v USING (query_id, no) JOIN mail m ON m.no = f.no)
        SELECT query_id, no, CAST(tier AS BIGINT) AS tier, round(bm25_score, 6) AS bm25_score, position FROM
        ({top_sql('tiers', 'tier, ' + NEWEST_SQL, 50)})"""),
    "fallback_search": (fallback_search, rf"""WITH {INDEX_SQL}, asked AS ({sql_view(HARD_QUERIES)}),
        heads AS (SELECT query_id, split_part(query_text, ' ', 1) AS query_text FROM asked), {bm25_sql('heads', 'prime')},
        empty AS (SELECT *, list_filter(string_split_regex(query_text, '\s+'), lambda t: len(t) >= 3)[1:4] AS t
                  FROM asked WHERE query_id NOT IN (SELECT query_id FROM prime)),
        wordy AS (SELECT query_id, array_to_string(t, ' OR ') AS query_text FROM empty
                  WHERE len(t) >= 2 AND NOT regexp_matches(query_text, '[가-힣]')), {bm25_sql('wordy', 'second')},
        by_token AS ({top_sql('second', 'round(bm25_score, 9) DESC, no', 20)}),
        parts AS (SELECT query_id, lower(unnest(CASE WHEN len(t) > 0 THEN t ELSE [query_text] END)) AS term FROM empty
                  WHERE query_id NOT IN (SELECT query_id FROM by_token)),
        held AS (SELECT DISTINCT p.query_id, m.no, m.deliverytime FROM parts p JOIN mail m
                 ON contains(lower(m.subject), p.term) OR contains(lower(m.plaintextbody), p.term))
        SELECT query_id, no, 'token' AS stage, position FROM by_token
        UNION ALL SELECT query_id, no, 'ilike_fb', position FROM ({top_sql('held', NEWEST_SQL, 20)})"""),
    "key_decisions": (key_decisions, f"""WITH {INDEX_SQL},
        asked AS (SELECT 0 AS query_id, '승인 onthsh thionan hold' AS query_text), {bm25_sql('asked', 'hits')}
        SELECT no, deliverytime, subject FROM mail WHERE no IN (SELECT no FROM hits) ORDER BY {NEWEST_SQL} LIMIT 10"""),
}
