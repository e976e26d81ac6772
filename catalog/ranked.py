"""Exact search, vectors, fusion, whole searches and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from mailsift import constants as C
from mailsift.functions import chunking, clean, entities, text
from mailsift.operators import bm25, containment, evaluate, exact, fusion, inverted_file, ngrams, ranking, threshold, vectors
from mailsift.operators.joins import join_small
from mailsift.plans import search as plans
from mailsift.storage import materialise, new_path
from .common import (CASE_QUERIES, DECISIONS, ENTITIES, GLOSSARY, HELD_SQL, IDENTIFIER_QUERIES, INDEX_SQL, MAIL_SQL, NEWEST_SQL,
                     QUERIES, SYNONYMS, TIME_SQL, bm25_sql, grams, held, index, mail, quoted, sql_view, table, tidy, tokens_sql, top_sql, view)
from .text_search import TERM_SQL, distinct_sql, lists_sql, SYNONYM_SQL
from .texts import (CHUNK_SQL, DOMAIN_MARKED, ENTITY_MARKED, compact_sql, identifier_ctes, marked_sql, mask_sql, names_sql, unmarked_sql)

DIM = 64
TABLES, BITS = 8, 6


# --- vectors -------------------------------------------------------------------------------------------------

def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("no"),
                                                     F.col("embedding").alias("vector"))


def _query_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _benchmark_vectors(spark, sf_dir):
    """The vectors that stand for the benchmark texts."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return _query_vectors(spark, sf_dir).join(items, "query_id")


def _chunk_vectors(spark, sf_dir):
    """Five vectors are the chunks of one mail."""
    owner = F.floor(F.col("vec_id") / 5).cast("string")
    section = F.concat(F.lit("body_"), F.pmod("vec_id", F.lit(5)).cast("string"))
    chunks = table(spark, sf_dir, "embeddings").select(
        "vec_id", owner.alias("no"), F.concat_ws("_", owner, section).alias("chunk_id"), section.alias("section"),
        F.col("embedding").alias("vector"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("chunk_text"))
    return chunks.join(texts, "vec_id", "left").drop("vec_id")


def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return tidy(e.join(after, "vec_id").select("vec_id", vectors.cosine(F.col("embedding"), F.col("other"))
                                               .alias("cosine_score")))


def vector_topk(spark, sf_dir):
    return tidy(vectors.nearest(_query_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10))


def vector_topk_blocks(spark, sf_dir):
    """The same search by blocks on both sides, the way taken for large query tables."""
    pairs = vectors.candidate_pairs(_query_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10, block_rows=256,
                                    broadcast_queries=0)
    return tidy(vectors.best_pairs(pairs, 10))


def vector_min_score(spark, sf_dir):
    return tidy(vectors.nearest(_query_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10, min_score=0.5))


def similar_docs(spark, sf_dir):
    found = vectors.similar_documents(_vectors(spark, sf_dir))
    return tidy(found.withColumn("query_id", F.col("query_id").cast("bigint")))


def _named(prefix, number):
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 6, "0"))


def similar_docs_text_ids(spark, sf_dir):
    return tidy(vectors.similar_documents(_vectors(spark, sf_dir).withColumn("no", _named("m", F.col("no")))))


def chunk_search(spark, sf_dir):
    found = vectors.nearest_by_chunk(_benchmark_vectors(spark, sf_dir), _chunk_vectors(spark, sf_dir), 10)
    shown = found.join(mail(spark, sf_dir).select("no", "sendername"), "no", "left")
    return tidy(shown.select("query_id", "no", "section", "chunk_text", "sendername", "cosine_score", "position"))


def chunk_search_few_owners(spark, sf_dir):
    """A hundred vectors are the chunks of one mail: the best chunks of all belong to few mails, and k mails come back."""
    owner = F.floor(F.col("vec_id") / 100).cast("string")
    chunks = table(spark, sf_dir, "embeddings").select(
        owner.alias("no"), F.concat_ws("/", owner, F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("chunk_id"),
        F.lit("body").alias("section"), F.lit("").alias("chunk_text"), F.col("embedding").alias("vector"))
    found = vectors.nearest_by_chunk(_query_vectors(spark, sf_dir), chunks, 4)
    return tidy(found.select("query_id", "no", "chunk_id", "cosine_score", "position"))


def vector_lists(spark, sf_dir):
    """Nearest vectors by the inverted-file index: two probes, then the lists that may still matter."""
    path = new_path(spark, "vector-lists")
    inverted_file.write_lists(_vectors(spark, sf_dir), path, lists=16, buckets=8)
    found = inverted_file.nearest_by_lists(
        _query_vectors(spark, sf_dir), inverted_file.read_lists(spark, path), 10, probes=2, exact=True)
    return tidy(found)


def vector_lsh(spark, sf_dir):
    return tidy(vectors.nearest_approximate(_query_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10, DIM, TABLES, BITS))


def vector_lsh_recall(spark, sf_dir):
    """Share of the exact neighbours that are found, and of all pairs that are scored for it."""
    q, v = _query_vectors(spark, sf_dir), _vectors(spark, sf_dir)
    found = vectors.nearest_approximate(q, v, 10, DIM, TABLES, BITS)
    work = vectors.scored_share(q, v, 10, DIM, TABLES, BITS).first()
    return tidy(vectors.recall_against(found, vectors.nearest(q, v, 10)).withColumns(
        {"scored": F.lit(work["scored"]), "share": F.lit(work["share"])}))


def embed_documents(spark, sf_dir):
    m = mail(spark, sf_dir)
    texts = m.select("no", text.embedding_text(F.col("subject"), F.col("plaintextbody")).alias("text"))
    slots = vectors.embed(texts, "text").select("no", F.posexplode("vector").alias("slot", "weight"))
    return tidy(slots.where(F.col("weight") != 0))


def embed_chunks(spark, sf_dir):
    made = vectors.embed(chunking.chunk_table(mail(spark, sf_dir)), "chunk_text")
    filled = F.filter("vector", lambda x: x != 0)
    return tidy(made.select("chunk_id", F.size(filled).alias("slots"), F.array_max("vector").alias("largest"),
                            (F.array_position("vector", F.array_max("vector")) - 1).alias("largest_slot")))


# --- exact search --------------------------------------------------------------------------------------------

def exact_search(spark, sf_dir):
    found = exact.exact_search(mail(spark, sf_dir), view(spark, sf_dir, IDENTIFIER_QUERIES), 50,
                               grams=grams(spark, sf_dir))
    return tidy(found.select("query_id", "no", "exact_tier", "exact_rank", "match_reason"))


def filtered_exact_search(spark, sf_dir):
    found = exact.exact_search(mail(spark, sf_dir), view(spark, sf_dir, IDENTIFIER_QUERIES), 5, held(spark, sf_dir),
                               grams(spark, sf_dir))
    return tidy(found.select("query_id", "no", "exact_tier", "exact_rank", "match_reason"))


def exact_matches(spark, sf_dir):
    found = exact.find_matches(mail(spark, sf_dir), view(spark, sf_dir, IDENTIFIER_QUERIES), grams=grams(spark, sf_dir))
    return tidy(found.groupBy("query_id").agg(F.count("*").alias("matches")))


def total_matches(spark, sf_dir):
    q = view(spark, sf_dir, IDENTIFIER_QUERIES)
    primary = bm25.match_counts(bm25.match_scores(index(spark, sf_dir), q))
    return exact.total_matches(primary, bm25.match_counts(exact.find_matches(
        mail(spark, sf_dir), q, grams=grams(spark, sf_dir))))


def merge_exact(spark, sf_dir):
    q = view(spark, sf_dir, IDENTIFIER_QUERIES)
    primary = bm25.search(index(spark, sf_dir), q, 20).select("query_id", "no", "bm25_score")
    merged = exact.merge_exact(primary, exact.exact_search(mail(spark, sf_dir), q, 20,
                                                           grams=grams(spark, sf_dir)))
    return tidy(merged.select("query_id", "no", "bm25_score", "exact_tier", "exact_rank", "exact_score"))


def containment_pairs(spark, sf_dir):
    """Which documents hold which benchmark text, whole and case-insensitive."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.lit("text").alias("field"),
                                                    "text")
    items = table(spark, sf_dir, "benchmark")
    hits = containment.find_terms(docs, items.select(F.col("text").alias("term")), terms_per_scan=64)
    return hits.select(F.col("key").cast("bigint").alias("doc_id"), F.md5("term").alias("passage")).distinct()


def gram_containment(spark, sf_dir):
    """Which mails hold which parts of benchmark texts in their bodies, by the 3-gram index: parts of 1 to 24 characters."""
    parts = F.array(*[F.substring("text", 5, n) for n in (1, 2, 3, 4, 9, 24)])
    terms = table(spark, sf_dir, "benchmark").select(F.explode(parts).alias("term"))
    hits = ngrams.find_terms(grams(spark, sf_dir), terms, ["plaintextbody"])
    counts = hits.groupBy("term").agg(F.count("*").alias("mails"), F.min("key").alias("first_no"))
    return counts.select(F.md5("term").alias("part"), "mails", "first_no")


def gram_compact(spark, sf_dir):
    """Mails whose case or order number holds the digits of a query's number, whatever signs stand between."""
    path = new_path(spark, "compact-grams")
    held = containment.text_fields(mail(spark, sf_dir), "no", ["hvdc_cases", "lpo_numbers"])
    ngrams.write_grams(held, path, forms=ngrams.FORMS, buckets=8, parts=8)
    numbers = F.array(F.concat(F.lit("lpo."), F.col("query_id") + 1000), F.concat(F.lit("e 00/"), F.col("query_id")),
                      F.col("query_id").cast("string"))
    asked = view(spark, sf_dir, QUERIES).select("query_id", F.explode(numbers).alias("term"))
    hits = ngrams.find_terms(ngrams.read_grams(spark, path), asked.select("term"), form="compact")
    return hits.join(asked, "term").select("query_id", "term", F.col("key").alias("no"), "field")


# --- signals -------------------------------------------------------------------------------------------------

def _hits(spark, sf_dir, queries=QUERIES, k=20):
    q = view(spark, sf_dir, queries)
    found = materialise(bm25.search(index(spark, sf_dir), q, k).select("query_id", "no", "bm25_score"), "hits")
    return join_small(mail(spark, sf_dir), found, ["no"], spread="no").join(q, "query_id")


def rrf_score(spark, sf_dir):
    """Reciprocal ranks of every match, not of a cut list: groups of any size."""
    scores = bm25.match_scores(index(spark, sf_dir), view(spark, sf_dir, QUERIES)).withColumn(
        "bm25_score", F.round("bm25_score", 3))
    scores = scores.withColumn("bm25_score", F.when(F.col("bm25_score") > 0.4, F.col("bm25_score")))
    scores = materialise(scores, "scores")
    return tidy(fusion.rrf(scores, "bm25_score", "rrf").select("query_id", "no", "rrf"))


def rrf_events(spark, sf_dir):
    """Competition ranks of event values per type, five groups that hold all rows."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") > 1, F.col("value")).alias("value"))
    ranked = ranking.competition_rank(e, ["event_type"], "value", "rank", ascending=True, spread="event_id")
    return tidy(ranked.select("event_id", "rank"))


def minmax_norm(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return tidy(ranking.scale_min_max(e, ["event_type"], "value", "scaled", "event_id").select("event_id", "scaled"))


def recency_score(spark, sf_dir):
    m = mail(spark, sf_dir).withColumn("query_id", F.col("stage")).where(F.col("stage").isNotNull())
    return tidy(fusion.recency(m).select("no", "recency_score"))


def field_score(spark, sf_dir):
    rows = exact.with_search_terms(_hits(spark, sf_dir, IDENTIFIER_QUERIES))
    return tidy(rows.select("query_id", "no", exact.field_match(rows, F.col("terms")).alias("field_match")))


def match_reason(spark, sf_dir):
    rows = exact.with_search_terms(_hits(spark, sf_dir, IDENTIFIER_QUERIES))
    return rows.select("query_id", "no", exact.match_reason(rows, F.col("terms")).alias("match_reason"))


def entity_score(spark, sf_dir):
    rows = _hits(spark, sf_dir)
    score = fusion.entity_match(rows, entities.entity_map(F.col("query_text"), ENTITIES), text.query_terms(F.col("query_text")))
    return tidy(rows.select("query_id", "no", score.alias("entity_match")))


def rrf_fusion(spark, sf_dir):
    """Word and vector ranks of the benchmark queries in one score."""
    words = bm25.search(index(spark, sf_dir), view(spark, sf_dir, QUERIES), 50).select("query_id", "no", "bm25_score")
    near = vectors.nearest(_benchmark_vectors(spark, sf_dir), _vectors(spark, sf_dir), 50).drop("position")
    both = words.join(near, ["query_id", "no"], "full_outer")
    both = both.withColumns({"bm25_rrf": fusion.rrf_in_candidates(F.col("bm25_score")),
                             "vector_rrf": fusion.rrf_in_candidates(F.col("cosine_score"))})
    score = 10.0 * F.col("bm25_rrf") + 8.0 * F.col("vector_rrf")
    return tidy(both.select("query_id", "no", score.alias("score")))


# --- whole searches ------------------------------------------------------------------------------------------

def rerank_full(spark, sf_dir):
    ranked = fusion.rerank(_hits(spark, sf_dir).drop("query_text"), view(spark, sf_dir, QUERIES))
    return tidy(ranked.select("query_id", "no", "field_match", "entity_match", "recency_score", "decision_signal", "score",
                              "position"))


def _keyword(spark, sf_dir, queries, **options):
    q = view(spark, sf_dir, queries)
    return plans.keyword_search(mail(spark, sf_dir), index(spark, sf_dir), q, 20, glossary=GLOSSARY, synonyms=SYNONYMS,
                                grams=grams(spark, sf_dir), **options)


def rerank_identifier(spark, sf_dir):
    ranked = _keyword(spark, sf_dir, IDENTIFIER_QUERIES)
    return tidy(ranked.select("query_id", "no", "exact_tier", "exact_rank", "score", "match_reason", "position"))


def hybrid_search(spark, sf_dir):
    found = plans.hybrid_search(mail(spark, sf_dir), index(spark, sf_dir), view(spark, sf_dir, QUERIES),
                                _benchmark_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10, glossary=GLOSSARY,
                                synonyms=SYNONYMS)
    return tidy(found.select("query_id", "no", "bm25_score", "cosine_score", "score", "position"))


def fused_lists(spark, sf_dir):
    """All hits of each benchmark text by score and by time, fused without reading both lists to the end."""
    by_words = materialise(bm25.match_scores(index(spark, sf_dir), view(spark, sf_dir, QUERIES)), "all-hits")
    times = mail(spark, sf_dir).select("no", F.unix_seconds(clean.timestamp(F.col("deliverytime"))).alias("score"))
    lists = {"words": by_words.withColumnRenamed("bm25_score", "score"),
             "time": by_words.select("query_id", "no").join(times, "no").withColumn("score", F.col("score").cast("double"))}
    found = threshold.fused_top(threshold.write_ranks(lists), 10, {"words": 10.0, "time": 8.0})
    return tidy(found.select("query_id", "no", "score", "position"))


def filtered_keyword_search(spark, sf_dir):
    ranked = _keyword(spark, sf_dir, CASE_QUERIES, allowed=held(spark, sf_dir))
    return tidy(ranked.select("query_id", "no", "mode", "exact_tier", "exact_rank", "score", "position"))


def filtered_hybrid_search(spark, sf_dir):
    found = plans.hybrid_search(mail(spark, sf_dir), index(spark, sf_dir), view(spark, sf_dir, QUERIES),
                                _benchmark_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10, glossary=GLOSSARY,
                                synonyms=SYNONYMS, allowed=held(spark, sf_dir))
    return tidy(found.select("query_id", "no", "bm25_score", "cosine_score", "score", "position"))


def presented_results(spark, sf_dir):
    q = view(spark, sf_dir, IDENTIFIER_QUERIES)
    ranked = _keyword(spark, sf_dir, IDENTIFIER_QUERIES)
    shown = plans.presented(ranked, mail(spark, sf_dir), q)
    return tidy(shown.select("query_id", "no", "position", "month", "deliverytime", "senderemail", "recipientto", "snippet",
                             "entities"))


def display_results(spark, sf_dir):
    shown = plans.presented(_keyword(spark, sf_dir, IDENTIFIER_QUERIES), mail(spark, sf_dir),
                            view(spark, sf_dir, IDENTIFIER_QUERIES))
    return tidy(shown.select("query_id", "no", "position", "month", "deliverytime", "senderemail", "recipientto"))


# --- evaluation ----------------------------------------------------------------------------------------------

EVAL_QUERIES = """SELECT item_id AS query_id, text AS query_text,
    CASE WHEN item_id % 4 = 0 THEN 'short' ELSE 'long' END AS category FROM {benchmark}"""
MODES = ["fts", "email"]


def _truth(spark, sf_dir):
    """Documents that hold the benchmark text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.lit("text").alias("field"),
                                                    "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("term"))
    return containment.find_terms(docs, items).join(items, "term").select("query_id", F.col("key").alias("no"))


def _results(spark, sf_dir):
    words = bm25.search(index(spark, sf_dir), view(spark, sf_dir, QUERIES), 10).select("query_id", "no", "position")
    near = vectors.nearest(_benchmark_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10).select("query_id", "no", "position")
    return words.withColumn("mode", F.lit("fts")).unionByName(near.withColumn("mode", F.lit("email")))


def _scores(spark, sf_dir, results=None):
    results = _results(spark, sf_dir) if results is None else results
    return evaluate.scores(view(spark, sf_dir, EVAL_QUERIES), results, _truth(spark, sf_dir), MODES)


def eval_text_ids(spark, sf_dir):
    """Words, chunks and mails against each other, with query ids that are text."""
    queries = view(spark, sf_dir, EVAL_QUERIES).withColumn("query_id", _named("q", F.col("query_id")))
    truth = _truth(spark, sf_dir).withColumn("query_id", _named("q", F.col("query_id")))
    asked = _benchmark_vectors(spark, sf_dir).withColumn("query_id", _named("q", F.col("query_id")))
    found = {"fts": bm25.search(index(spark, sf_dir), queries.select("query_id", "query_text"), 10),
             "chunk": vectors.nearest_by_chunk(asked, _chunk_vectors(spark, sf_dir), 10),
             "email": vectors.nearest(asked, _vectors(spark, sf_dir), 10)}
    results = reduce(DataFrame.unionByName, [
        df.select("query_id", "no", "position", F.lit(mode).alias("mode")) for mode, df in found.items()])
    measured = evaluate.scores(queries, results, truth, list(found))
    return tidy(measured.select("mode", "query_id", "result_count", "recall", "mrr"))


def eval_recall(spark, sf_dir):
    return tidy(_scores(spark, sf_dir).select("mode", "query_id", "recall"))


def eval_mrr(spark, sf_dir):
    return tidy(_scores(spark, sf_dir).select("mode", "query_id", "mrr"))


def eval_report(spark, sf_dir):
    return tidy(evaluate.report(_scores(spark, sf_dir)))


def eval_zero_rate(spark, sf_dir):
    return tidy(evaluate.zero_result_rate(_scores(spark, sf_dir), "short"))


def eval_export(spark, sf_dir):
    results = materialise(_results(spark, sf_dir), "results")
    lists = evaluate.result_lists(view(spark, sf_dir, EVAL_QUERIES), _scores(spark, sf_dir, results), results)
    return tidy(lists.select("mode", "query_id", "category", "query_text", "result_count", "recall", "nos"))


# --- SQL -----------------------------------------------------------------------------------------------------

COSINE = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
PAIRS_SQL = f"""pairs AS (SELECT q.vec_id AS query_id, CAST(v.vec_id AS VARCHAR) AS no,
    round({COSINE.format('q.embedding', 'v.embedding')}, 9) AS cosine_score FROM embeddings q, embeddings v)"""
NEAR_SQL = PAIRS_SQL.replace("embeddings q,", "(SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) q,")
BY_COSINE = "round(cosine_score, 9) DESC, no"


def nearest_sql(k, where="true"):
    return f"""WITH {PAIRS_SQL} SELECT query_id, no, round(cosine_score, 6) AS cosine_score, position FROM
        ({top_sql(f"(SELECT * FROM pairs WHERE {where})", BY_COSINE, k)})"""


FIELD_TEXTS = [f for f in C.EXACT_FIELDS if f != "case_numbers"]
ID_ONLY = r"regexp_full_match({0}, '\d{{1,5}}|20\d{{2}}|20\d{{4}}')"


def exact_ctes(k, queries=IDENTIFIER_QUERIES, mails="mail"):
    """CTEs ending in `exact` (query_id, no, exact_tier, exact_rank, match_reason)."""
    body = " OR ".join(f"contains(lower({f}), lower(t.term))" for f in FIELD_TEXTS if f != "plaintextbody")
    strong = " OR ".join(f"len(list_filter(terms, lambda x: {names_sql(f'coalesce({f}, chr(39))', 'x')})) > 0"
                         for f in FIELD_TEXTS if f != "plaintextbody")
    strong = strong.replace("chr(39)", "''")
    return rf"""asked AS ({sql_view(queries)}), {identifier_ctes('asked', 'ident')},
    named AS (SELECT * FROM ident WHERE len(terms) > 0),
    one AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM named),
    found AS (SELECT query_id, no, min(tier) AS tier FROM (
        SELECT t.query_id, m.no, 0 AS tier FROM one t JOIN {mails} m ON m.no = regexp_replace(t.term, '\.0$', '')
        UNION ALL SELECT t.query_id, m.no, CASE WHEN {body} THEN 1 ELSE 2 END FROM one t JOIN {mails} m
            ON (NOT {ID_ONLY.replace("{0}", "t.term").replace("{{", "{").replace("}}", "}")})
            AND ({body} OR contains(lower(m.plaintextbody), lower(t.term)))) GROUP BY query_id, no),
    matched AS (SELECT f.query_id, f.tier, m.*, n.terms FROM found f JOIN mail m USING (no) JOIN named n USING (query_id)),
    tiers AS (SELECT *, CASE WHEN tier = 2 AND ({strong}) THEN 1 ELSE tier END AS exact_tier FROM matched),
    best AS (SELECT *, {reason_sql('terms')} AS reason FROM
        ({top_sql('tiers', f'exact_tier, {NEWEST_SQL}', k, rank='exact_rank')})),
    exact AS (SELECT query_id, no, exact_tier, exact_rank,
        'exact identifier, ' || CASE WHEN reason <> '' THEN reason ELSE 'body' END AS match_reason FROM best)"""


def reason_sql(terms):
    whens = " ".join(f"WHEN {names_sql(f'coalesce({f}, {empty()})', 'x')} THEN '{label}:' || x"
                     for f, label in C.FIELD_LABELS.items() if f != "case_numbers")
    reasons = f"list_filter(list_transform({terms}[1:6], lambda x: CASE {whens} END), lambda r: r IS NOT NULL)"
    return (f"array_to_string(list_filter({reasons}, lambda r, i: list_position({reasons}, r) = i)[1:4], ', ')")


def empty():
    return "''"


def field_sql(terms):
    parts = [f"CASE WHEN len(list_filter({terms}[1:8], lambda x: {names_sql(f'coalesce({f}, {empty()})', 'x')})) > 0 "
             f"THEN CAST({w} AS DOUBLE) ELSE 0 END" for f, w in C.FIELD_WEIGHTS.items() if f != "case_numbers"]
    return f"least({' + '.join(parts)}, 1.0)"


def terms_ctes(source):
    return f"""{identifier_ctes(source, 'ti')},
    wanted AS (SELECT query_id, query_text, terms AS idents, {distinct_sql('w')} AS words,
               CASE WHEN len(terms) > 0 THEN terms ELSE {distinct_sql('w')} END AS terms FROM
               (SELECT query_id, query_text, terms, {TERM_SQL.format('query_text')} AS w FROM ti))"""


HEADER_SQL = "lower(concat_ws(' ', " + ", ".join(f"coalesce({f}, '')" for f in C.ENTITY_FIELDS) + "))"


def entity_list_sql(patterns, order):
    parts = []
    for tag in order:
        values = f"list_transform(regexp_extract_all({marked_sql('query_text')}, '(?i){patterns[tag]}'), lambda x: {unmarked_sql('x')})"
        if tag == "Ref":
            values = f"list_transform({values}, lambda x: {mask_sql('x')})"
        parts.append(f"list_filter({values}, lambda x, i: list_position({values}, x) = i)[1:4]")
    return f"flatten([{', '.join(parts)}])"


def entity_match_sql(values, words):
    wanted = f"list_concat({values}, {words}[1:6])"
    return (f"least(len(list_filter({wanted}, lambda x: contains({HEADER_SQL}, lower(x)))) / "
            f"CAST(greatest(len({wanted}), 1) AS DOUBLE), 1.0)")


AGE_SQL = f"""CASE WHEN {TIME_SQL} IS NULL THEN 9999 ELSE
    floor(epoch(max({TIME_SQL}) OVER (PARTITION BY query_id) - {TIME_SQL}) / 86400) END"""


def rrf_sql(value, order="DESC"):
    return (f"CASE WHEN {value} IS NULL THEN 0.0 ELSE 1.0 / (60 + rank() OVER (PARTITION BY query_id "
            f"ORDER BY round({value}, 9) {order} NULLS LAST)) END")


def rerank_ctes(candidates, queries, exact_columns=False):
    """CTEs ending in `ranked` for candidates (query_id, no, bm25_score, cosine_score, exact_*)."""
    decision = " OR ".join(f"contains(lower(concat(coalesce(subject, ''), ' ', coalesce(hvdc_cases, ''))), '{w}')"
                           for w in C.DECISION_WORDS)
    base = "coalesce(match_reason, '')" if exact_columns else "''"
    both = f"list_filter([{base}, reason], lambda r: r <> '')"
    return f"""{terms_ctes(queries)},
    valued AS (SELECT *, {entity_list_sql(DOMAIN_MARKED, list(DOMAIN_MARKED))} AS ents FROM wanted),
    cand AS (SELECT c.*, m.* EXCLUDE (no), w.* EXCLUDE (query_id) FROM {candidates} c JOIN mail m USING (no)
             JOIN valued w USING (query_id)),
    aged AS (SELECT *, {AGE_SQL} AS age FROM cand),
    sig AS (SELECT *, {rrf_sql('bm25_score')} AS r1, {rrf_sql('cosine_score')} AS r2, {rrf_sql('exact_rank', 'ASC')} AS r3,
        {field_sql('terms')} AS field_match, {entity_match_sql('ents', 'words')} AS entity_match,
        {reason_sql('terms')} AS reason,
        CASE WHEN {decision} THEN 1.0 ELSE 0.0 END AS decision_signal,
        min(age) OVER (PARTITION BY query_id) AS low, max(age) OVER (PARTITION BY query_id) AS high,
        max({TIME_SQL}) OVER (PARTITION BY query_id) AS newest,
        count(exact_rank) OVER (PARTITION BY query_id) > 0 AND len(idents) > 0 AS by_ident FROM aged),
    sig2 AS (SELECT *, CASE WHEN newest IS NULL THEN 0.0 WHEN high > low THEN 1.0 - (age - low) / CAST(high - low AS DOUBLE)
        WHEN high <> 0 THEN 0.0 ELSE 1.0 END AS recency_score FROM sig),
    fused AS (SELECT *, 10.0 * CAST(r1 AS DOUBLE) + 8.0 * CAST(r2 AS DOUBLE) + 8.0 * CAST(r3 AS DOUBLE)
        + 0.5 * CASE WHEN exact_rank IS NULL THEN 0 ELSE 1 END + 0.12 * field_match + 0.12 * entity_match
        + 0.05 * recency_score + 0.05 * decision_signal AS score,
        array_to_string({both}[1:4], ', ') AS reasons FROM sig2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
        CASE WHEN by_ident THEN coalesce(exact_tier, 9) ELSE 0 END,
        CASE WHEN by_ident THEN coalesce(exact_rank, 999999) ELSE 0 END, round(score, 9) DESC, no) AS position FROM fused)"""


def top_hits(queries, name, k):
    return f"""{bm25_sql(queries, name)}, {name}_top AS
        ({top_sql(name, 'round(bm25_score, 9) DESC, no', k, 'query_id, no, bm25_score')})"""


QUERIES_CTE = f"queries AS ({sql_view(QUERIES)})"
NO_EXACT = "CAST(NULL AS BIGINT) AS exact_rank, CAST(NULL AS BIGINT) AS exact_tier"
REWRITTEN = f"""q0 AS ({sql_view(QUERIES)}),
    q1 AS (SELECT query_id, query_text, {TERM_SQL.format('query_text')} AS w FROM q0),
    q2 AS (SELECT query_id, query_text, flatten([w, {lists_sql(lambda e: e[1][:3])}, {SYNONYM_SQL}]) AS w FROM q1),
    q3 AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l FROM q2),
    asked AS (SELECT query_id, array_to_string(list_filter(w, lambda x, i: list_position(l, lower(x)) = i)[1:5], ' OR ')
              AS query_text FROM q3)"""
KEYWORD_SQL = f"""{INDEX_SQL}, {exact_ctes(20)}, {top_hits('asked', 'hits', 20)},
    joined AS (SELECT query_id, no, bm25_score, CAST(NULL AS DOUBLE) AS cosine_score, exact_tier, exact_rank, match_reason
               FROM hits_top FULL JOIN exact USING (query_id, no)), {rerank_ctes('joined', 'asked', True)}"""
CHUNK_PAIRS_SQL = NEAR_SQL.replace("pairs AS", "chunk_pairs AS").replace(
    "CAST(v.vec_id AS VARCHAR) AS no", "v.vec_id, (v.vec_id // 5) || '_body_' || (v.vec_id % 5) AS no")
CHUNK_RESULTS_SQL = f"""{CHUNK_PAIRS_SQL}, chunk_best AS (SELECT query_id, CAST(vec_id // 5 AS VARCHAR) AS no,
        max(cosine_score) AS cosine_score FROM ({top_sql('chunk_pairs', BY_COSINE, 100)}) GROUP BY 1, 2),
    chunk_results AS ({top_sql('chunk_best', BY_COSINE, 10)})"""
LSH_SQL = f"""{PAIRS_SQL},
    slots AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
    planes AS (SELECT t, b, d, CASE WHEN left(md5(concat(t, ',', b, ',', d)), 1) < '8' THEN 1 ELSE -1 END AS s
               FROM range({TABLES}) i(t), range({BITS}) j(b), range({DIM}) k(d)),
    sides AS (SELECT vec_id, t, b, sum(x * s) > 0 AS above FROM slots JOIN planes USING (d) GROUP BY vec_id, t, b),
    codes AS (SELECT vec_id, t, CAST(sum(CASE WHEN above THEN 1 << b ELSE 0 END) AS BIGINT) AS code FROM sides
              GROUP BY vec_id, t),
    flips AS (SELECT 0 AS f UNION ALL SELECT 1 << b FROM range({BITS}) j(b)),
    asked AS (SELECT vec_id, t, xor(code, f) AS code FROM codes, flips),
    met AS (SELECT q.vec_id AS query_id, CAST(v.vec_id AS VARCHAR) AS no FROM asked q JOIN codes v USING (t, code)),
    near AS ({top_sql("(SELECT * FROM pairs JOIN (SELECT DISTINCT * FROM met) USING (query_id, no))", BY_COSINE, 10)})"""
EVAL_SQL = f"""{INDEX_SQL}, {QUERIES_CTE}, {bm25_sql('queries', 'hits')}, {NEAR_SQL},
    results AS (SELECT 'fts' AS mode, query_id, no, position FROM ({top_sql('hits', 'round(bm25_score, 9) DESC, no', 10)})
        UNION ALL SELECT 'email', query_id, no, position FROM ({top_sql('pairs', BY_COSINE, 10)})),
    truth AS (SELECT b.item_id AS query_id, CAST(d.doc_id AS VARCHAR) AS no FROM benchmark b JOIN documents d
              ON contains(lower(d.text), lower(b.text))),
    asked AS (SELECT *, unnest(['fts', 'email']) AS mode FROM ({sql_view(EVAL_QUERIES)})),
    scores AS (SELECT a.mode, a.query_id, a.category, a.query_text,
        (SELECT count(*) FROM results r WHERE r.mode = a.mode AND r.query_id = a.query_id) AS result_count,
        (SELECT count(*) FROM truth t WHERE t.query_id = a.query_id) AS expected,
        (SELECT count(*) FROM results r JOIN truth t USING (query_id, no) WHERE r.mode = a.mode
            AND r.query_id = a.query_id) AS found,
        (SELECT min(position) FROM results r JOIN truth t USING (query_id, no) WHERE r.mode = a.mode
            AND r.query_id = a.query_id) AS first_hit FROM asked a),
    measured AS (SELECT *, CASE WHEN expected > 0 THEN found / CAST(expected AS DOUBLE) END AS recall,
        CASE WHEN expected > 0 THEN coalesce(CAST(1 AS DOUBLE) / first_hit, 0) END AS mrr FROM scores)"""
EMBED_SQL = """words AS (SELECT id, unnest({tokens}) AS w FROM texts),
    slots AS (SELECT id, CAST(('0x' || substring(md5(w), 1, 8)) AS BIGINT) % 384 AS slot, count(*) AS n FROM words GROUP BY 1, 2),
    weights AS (SELECT id, slot, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS weight
                FROM slots)""".replace("{tokens}", tokens_sql("text", stop=False))

ENTRIES = {
    "cosine_pairs": (cosine_pairs, f"""SELECT a.vec_id, round({COSINE.format('a.embedding', 'b.embedding')}, 6)
        AS cosine_score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""),
    "vector_topk": (vector_topk, nearest_sql(10)),
    "vector_topk_blocks": (vector_topk_blocks, nearest_sql(10)),
    "vector_min_score": (vector_min_score, nearest_sql(10, "cosine_score >= 0.5")),
    "similar_docs": (similar_docs, nearest_sql(5, "no <> CAST(query_id AS VARCHAR)")),
    "vector_lists": (vector_lists, nearest_sql(10)),
    "chunk_search_few_owners": (chunk_search_few_owners, f"""WITH {PAIRS_SQL},
        chunks AS (SELECT query_id, CAST(CAST(no AS BIGINT) // 100 AS VARCHAR) AS no, lpad(no, 9, '0') AS chunk,
                          round(cosine_score, 9) AS cosine_score FROM pairs),
        best AS (SELECT query_id, no, max(cosine_score) AS cosine_score,
                        no || '/' || arg_min(chunk, (-cosine_score, chunk)) AS chunk_id FROM chunks GROUP BY query_id, no)
        SELECT query_id, no, chunk_id, round(cosine_score, 6) AS cosine_score, position
        FROM ({top_sql('best', BY_COSINE, 4)})"""),
    "chunk_search": (chunk_search, f"""WITH {MAIL_SQL}, {NEAR_SQL.replace("CAST(v.vec_id AS VARCHAR) AS no",
        "v.vec_id, (v.vec_id // 5) || '_body_' || (v.vec_id % 5) AS no")},
        top AS (SELECT query_id, vec_id, CAST(vec_id // 5 AS VARCHAR) AS no, cosine_score, position AS place FROM
                ({top_sql('pairs', BY_COSINE, 100)})),
        best AS (SELECT query_id, no, min(place) AS place, max(cosine_score) AS cosine_score,
                        arg_min(vec_id, place) AS vec_id FROM top GROUP BY query_id, no),
        cut AS ({top_sql('best', BY_COSINE, 10)})
        SELECT c.query_id, c.no, 'body_' || (c.vec_id % 5) AS section, d.text AS chunk_text, m.sendername,
               round(c.cosine_score, 6) AS cosine_score, c.position FROM cut c LEFT JOIN documents d ON d.doc_id = c.vec_id
        LEFT JOIN mail m ON m.no = c.no"""),
    "similar_docs_text_ids": (similar_docs_text_ids, nearest_sql(5, "no <> query_id").replace(
        "q.vec_id AS query_id, CAST(v.vec_id AS VARCHAR) AS no",
        "'m' || lpad(CAST(q.vec_id AS VARCHAR), 6, '0') AS query_id, 'm' || lpad(CAST(v.vec_id AS VARCHAR), 6, '0') AS no")),
    "vector_lsh": (vector_lsh, f"""WITH {LSH_SQL} SELECT query_id, no, round(cosine_score, 6) AS cosine_score, position
        FROM near"""),
    "vector_lsh_recall": (vector_lsh_recall, f"""WITH {LSH_SQL}, best AS ({top_sql('pairs', BY_COSINE, 10)})
        SELECT round(avg(CASE WHEN n.no IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, count(*) AS pairs,
               (SELECT count(*) FROM met) AS scored,
               round((SELECT count(*) FROM met) / (SELECT CAST(count(*) AS DOUBLE) FROM pairs), 6) AS share
        FROM best b LEFT JOIN near n USING (query_id, no)"""),
    "embed_documents": (embed_documents, f"""WITH {MAIL_SQL}, texts AS (SELECT no AS id, coalesce(subject, '') || ' ' ||
        coalesce(plaintextbody, '') AS text FROM mail), {EMBED_SQL}
        SELECT id AS no, slot, round(weight, 6) AS weight FROM weights"""),
    "embed_chunks": (embed_chunks, f"""WITH {CHUNK_SQL}, texts AS (SELECT no || '_' || section AS id, chunk_text AS text
        FROM chunks), {EMBED_SQL}
        SELECT t.id AS chunk_id, count(w.slot) AS slots, coalesce(round(max(weight), 6), 0) AS largest,
               coalesce(arg_min(slot, (-weight, slot)), 0) AS largest_slot FROM texts t LEFT JOIN weights w USING (id)
        GROUP BY t.id"""),
    "exact_search": (exact_search, f"""WITH {MAIL_SQL}, {exact_ctes(50)} SELECT query_id, no,
        CAST(exact_tier AS BIGINT) AS exact_tier, exact_rank, match_reason FROM exact"""),
    "filtered_exact_search": (filtered_exact_search, f"""WITH {MAIL_SQL}, {HELD_SQL}, {exact_ctes(5, mails='held')}
        SELECT query_id, no, CAST(exact_tier AS BIGINT) AS exact_tier, exact_rank, match_reason FROM exact"""),
    "exact_matches": (exact_matches, f"""WITH {MAIL_SQL}, {exact_ctes(50)} SELECT query_id, count(*) AS matches FROM found
        GROUP BY query_id"""),
    "total_matches": (total_matches, f"""WITH {INDEX_SQL}, {exact_ctes(50)}, {bm25_sql('asked', 'hits')}
        SELECT query_id, greatest(a.n, b.n) AS matches FROM (SELECT query_id, count(*) AS n FROM hits GROUP BY 1) a
        FULL JOIN (SELECT query_id, count(*) AS n FROM found GROUP BY 1) b USING (query_id)"""),
    "merge_exact": (merge_exact, f"""WITH {INDEX_SQL}, {exact_ctes(20)}, {top_hits('asked', 'hits', 20)}
        SELECT query_id, no, round(bm25_score, 6) AS bm25_score, CAST(exact_tier AS BIGINT) AS exact_tier, exact_rank,
               CASE WHEN exact_rank IS NULL THEN NULL ELSE CAST(1 AS DOUBLE) END AS exact_score
        FROM hits_top FULL JOIN exact USING (query_id, no)"""),
    "containment_pairs": (containment_pairs, """SELECT DISTINCT d.doc_id, md5(lower(b.text)) AS passage FROM benchmark b
        JOIN documents d ON contains(lower(d.text), lower(b.text))"""),
    "gram_containment": (gram_containment, f"""WITH {MAIL_SQL}, parts AS (SELECT DISTINCT lower(substring(text, 5, n)) AS term
        FROM benchmark, (VALUES (1), (2), (3), (4), (9), (24)) s(n))
        SELECT md5(term) AS part, count(*) AS mails, min(no) AS first_no FROM parts JOIN mail
        ON contains(lower(plaintextbody), term) GROUP BY term"""),
    "gram_compact": (gram_compact, f"""WITH {MAIL_SQL}, queries AS ({sql_view(QUERIES)}),
        asked AS (SELECT query_id, unnest(['lpo.' || (query_id + 1000), 'e 00/' || query_id, CAST(query_id AS VARCHAR)]) AS term
                  FROM queries),
        held AS (SELECT no, 'hvdc_cases' AS field, hvdc_cases AS text FROM mail
                 UNION ALL SELECT no, 'lpo_numbers', lpo_numbers FROM mail)
        SELECT query_id, term, no, field FROM asked JOIN held
        ON contains({compact_sql('text')}, {compact_sql('term')})"""),
    "rrf_score": (rrf_score, f"""WITH {INDEX_SQL}, {QUERIES_CTE}, {bm25_sql('queries', 'hits')},
        cut AS (SELECT query_id, no, CASE WHEN round(bm25_score, 3) > 0.4 THEN round(bm25_score, 3) END AS s FROM hits)
        SELECT query_id, no, round(CAST({rrf_sql('s')} AS DOUBLE), 6) AS rrf FROM cut"""),
    "rrf_events": (rrf_events, """SELECT event_id, CASE WHEN value > 1 THEN rank() OVER (PARTITION BY event_type, value > 1
        ORDER BY value) END AS rank FROM events"""),
    "minmax_norm": (minmax_norm, """WITH ends AS (SELECT event_type, min(value) AS low, max(value) AS high FROM events
        GROUP BY 1) SELECT event_id, round((value - low) / (high - low), 6) AS scaled FROM events JOIN ends USING (event_type)"""),
    "recency_score": (recency_score, f"""WITH {MAIL_SQL}, staged AS (SELECT *, stage AS query_id FROM mail
        WHERE stage IS NOT NULL), aged AS (SELECT no, query_id, {AGE_SQL} AS age FROM staged),
        ends AS (SELECT query_id, min(age) AS low, max(age) AS high FROM aged GROUP BY 1)
        SELECT no, round(1 - (age - low) / CAST(high - low AS DOUBLE), 6) AS recency_score FROM aged
        JOIN ends USING (query_id)"""),
    "field_score": (field_score, f"""WITH {INDEX_SQL}, asked AS ({sql_view(IDENTIFIER_QUERIES)}),
        {top_hits('asked', 'hits', 20)}, {terms_ctes('asked')}
        SELECT h.query_id, m.no, round({field_sql('w.terms')}, 6) AS field_match FROM hits_top h JOIN mail m USING (no)
        JOIN wanted w USING (query_id)"""),
    "match_reason": (match_reason, f"""WITH {INDEX_SQL}, asked AS ({sql_view(IDENTIFIER_QUERIES)}),
        {top_hits('asked', 'hits', 20)}, {terms_ctes('asked')}
        SELECT h.query_id, m.no, {reason_sql('w.terms').replace("coalesce(no,", "coalesce(m.no,")} AS match_reason
        FROM hits_top h JOIN mail m USING (no) JOIN wanted w USING (query_id)"""),
    "entity_score": (entity_score, f"""WITH {INDEX_SQL}, {QUERIES_CTE}, {top_hits('queries', 'hits', 20)},
        {terms_ctes('queries')}, valued AS (SELECT *, {entity_list_sql(ENTITY_MARKED, list(ENTITY_MARKED))} AS ents
        FROM wanted)
        SELECT h.query_id, m.no, round({entity_match_sql('w.ents', 'w.words')}, 6) AS entity_match FROM hits_top h
        JOIN mail m USING (no) JOIN valued w USING (query_id)"""),
    "rrf_fusion": (rrf_fusion, f"""WITH {INDEX_SQL}, {QUERIES_CTE}, {top_hits('queries', 'hits', 50)}, {NEAR_SQL},
        near AS ({top_sql('pairs', BY_COSINE, 50)}),
        both_ AS (SELECT query_id, no, bm25_score, cosine_score FROM hits_top FULL JOIN near USING (query_id, no))
        SELECT query_id, no, round(10.0 * CAST({rrf_sql('bm25_score')} AS DOUBLE)
            + 8.0 * CAST({rrf_sql('cosine_score')} AS DOUBLE), 6) AS score FROM both_"""),
    "rerank_full": (rerank_full, f"""WITH {INDEX_SQL}, {QUERIES_CTE}, {top_hits('queries', 'hits', 20)},
        candidates AS (SELECT *, CAST(NULL AS DOUBLE) AS cosine_score, {NO_EXACT} FROM hits_top),
        {rerank_ctes('candidates', 'queries')}
        SELECT query_id, no, round(field_match, 6) AS field_match, round(entity_match, 6) AS entity_match,
               round(recency_score, 6) AS recency_score, CAST(decision_signal AS DOUBLE) AS decision_signal,
               round(score, 6) AS score, position FROM ranked"""),
    "rerank_identifier": (rerank_identifier, f"""WITH {KEYWORD_SQL} SELECT query_id, no,
        CAST(exact_tier AS BIGINT) AS exact_tier, exact_rank, round(score, 6) AS score, reasons AS match_reason, position
        FROM ranked"""),
    "hybrid_search": (hybrid_search, f"""WITH {INDEX_SQL}, {REWRITTEN}, {top_hits('asked', 'hits', 20)}, {NEAR_SQL},
        near AS ({top_sql('pairs', BY_COSINE, 20)}),
        candidates AS (SELECT query_id, no, bm25_score, cosine_score, {NO_EXACT} FROM hits_top
                       FULL JOIN near USING (query_id, no)), {rerank_ctes('candidates', 'asked')}
        SELECT query_id, no, round(bm25_score, 6) AS bm25_score, round(cosine_score, 6) AS cosine_score,
               round(score, 6) AS score, position FROM ranked WHERE position <= 10"""),
    "fused_lists": (fused_lists, f"""WITH {INDEX_SQL}, {QUERIES_CTE}, {bm25_sql('queries', 'hits')},
        by_words AS (SELECT query_id, no, rank() OVER (PARTITION BY query_id ORDER BY bm25_score DESC) AS r FROM hits),
        timed AS (SELECT h.query_id, h.no, floor(epoch({TIME_SQL})) AS t FROM hits h JOIN mail m USING (no)),
        by_time AS (SELECT query_id, no, rank() OVER (PARTITION BY query_id ORDER BY t DESC) AS r FROM timed
                    WHERE t IS NOT NULL),
        fused AS (SELECT query_id, no, round(10.0 / (60 + w.r) + coalesce(8.0 / (60 + t.r), 0), 9) AS score
                  FROM by_words w LEFT JOIN by_time t USING (query_id, no))
        SELECT query_id, no, round(score, 6) AS score, position FROM ({top_sql('fused', 'score DESC, no', 10)})"""),
    "filtered_keyword_search": (filtered_keyword_search, f"""WITH {INDEX_SQL}, {HELD_SQL},
        {exact_ctes(20, CASE_QUERIES, 'held')}, {bm25_sql('asked', 'hits')},
        hits_top AS ({top_sql('(SELECT * FROM hits WHERE no IN (SELECT no FROM held))', 'round(bm25_score, 9) DESC, no', 20,
                              'query_id, no, bm25_score')}),
        joined AS (SELECT query_id, no, bm25_score, CAST(NULL AS DOUBLE) AS cosine_score, exact_tier, exact_rank, match_reason
                   FROM hits_top FULL JOIN exact USING (query_id, no)), {rerank_ctes('joined', 'asked', True)}
        SELECT query_id, no, CASE WHEN bm25_score IS NULL THEN 'exact' ELSE 'bm25' END AS mode,
               CAST(exact_tier AS BIGINT) AS exact_tier, exact_rank, round(score, 6) AS score, position FROM ranked"""),
    "filtered_hybrid_search": (filtered_hybrid_search, f"""WITH {INDEX_SQL}, {HELD_SQL}, {REWRITTEN}, {bm25_sql('asked', 'hits')},
        hits_top AS ({top_sql('(SELECT * FROM hits WHERE no IN (SELECT no FROM held))', 'round(bm25_score, 9) DESC, no', 20,
                              'query_id, no, bm25_score')}), {NEAR_SQL},
        near AS ({top_sql('(SELECT * FROM pairs WHERE no IN (SELECT no FROM held))', BY_COSINE, 20)}),
        candidates AS (SELECT query_id, no, bm25_score, cosine_score, {NO_EXACT} FROM hits_top
                       FULL JOIN near USING (query_id, no)), {rerank_ctes('candidates', 'asked')}
        SELECT query_id, no, round(bm25_score, 6) AS bm25_score, round(cosine_score, 6) AS cosine_score,
               round(score, 6) AS score, position FROM ranked WHERE position <= 10"""),
    "presented_results": (presented_results, None),
    "display_results": (display_results, f"""WITH {KEYWORD_SQL} SELECT query_id, no, position,
        left(month, 4) || '-' || substring(month, 5) AS month,
        coalesce(strftime({TIME_SQL}, '%Y-%m-%d %H:%M:%S'), deliverytime, '') AS deliverytime,
        left(senderemail, 1) || '****@' || split_part(senderemail, '@', 2) AS senderemail,
        coalesce('d****@' || split_part(recipientto, '@', 2), '') AS recipientto FROM ranked"""),
    "eval_text_ids": (eval_text_ids, f"""WITH {EVAL_SQL.replace("['fts', 'email']", "['fts', 'chunk', 'email']").replace(
        "results AS (", f"{CHUNK_RESULTS_SQL}, results AS (SELECT 'chunk' AS mode, query_id, no, position FROM chunk_results "
        "UNION ALL ")} SELECT mode, 'q' || lpad(CAST(query_id AS VARCHAR), 6, '0') AS query_id, result_count,
        round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM measured"""),
    "eval_recall": (eval_recall, f"WITH {EVAL_SQL} SELECT mode, query_id, round(recall, 6) AS recall FROM measured"),
    "eval_mrr": (eval_mrr, f"WITH {EVAL_SQL} SELECT mode, query_id, round(mrr, 6) AS mrr FROM measured"),
    "eval_report": (eval_report, f"""WITH {EVAL_SQL}, sums AS (SELECT mode, category, avg(recall) AS recall, avg(mrr) AS mrr,
        count(*) AS queries, avg(CASE WHEN result_count = 0 THEN 1.0 ELSE 0.0 END) AS zero FROM measured
        GROUP BY GROUPING SETS ((mode, category), (mode)))
        SELECT mode, coalesce(category, 'OVERALL') AS category, round(recall, 6) AS recall, round(mrr, 6) AS mrr, queries,
               round(CAST(zero AS DOUBLE), 6) AS zero_result_rate FROM sums"""),
    "eval_zero_rate": (eval_zero_rate, f"""WITH {EVAL_SQL} SELECT mode, CAST(avg(CASE WHEN result_count = 0 THEN 1.0 ELSE 0.0
        END) AS DOUBLE) AS zero_result_rate FROM measured WHERE category = 'short' GROUP BY mode"""),
    "eval_export": (eval_export, f"""WITH {EVAL_SQL}, lists AS (SELECT mode, query_id, string_agg(no, '|' ORDER BY position)
        AS nos FROM results GROUP BY mode, query_id)
        SELECT mode, query_id, category, query_text, result_count, round(recall, 6) AS recall, coalesce(nos, '') AS nos
        FROM measured LEFT JOIN lists USING (mode, query_id)"""),
}
