"""The registered queries of this subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, fuzzy_lines, hard_negatives, html_text, near_dedup, packing, pseudonyms, ranked_terms, substrings, token_files, topk, toxicity, url_rules

URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
PSEUDONYM_KEY = os.environ.get("PSEUDONYM_KEY", "change me")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * r.c[i])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.c) = len(r.c) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * r.c[i])) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.c) = len(r.c) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM pairs WHERE same)
  WHERE place <= 5),
ranked AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, CAST(row_number() OVER (
           PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


RANKED_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
stats AS (SELECT count(*) AS total_docs, CAST(sum(len(t)) AS BIGINT) AS total_terms FROM d WHERE len(t) > 0),
held AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
tfs AS (SELECT doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * total_docs + 2) / (2 * df + 1))) AS BIGINT)
           * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total_docs) // total_terms)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN dfs USING (term), stats GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def vocabulary() -> str:
    """The place of the public vocabulary; workers read the same path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bounded(spark: SparkSession) -> None:
    """Arrow batches of a few MB: workers hold one batch of long texts and its arrays at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs of pages whose path names a labelled document; blocked if it is toxic or of low quality."""
    marks = labels.groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("blocked"))
    doc_id = F.regexp_extract(url_rules.path(F.col("url")), "^/[a-z]+/([0-9]{1,18})", 1).try_cast("long")
    return pages.select("url", doc_id.alias("doc_id")).join(marks, "doc_id").select("url", "blocked")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = url_rules.mine(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return url_rules.judge(pages, URL_RULES, mined).drop("url")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, keep_text=False)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op13_ranked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_terms.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


ENTRIES = {
    "op1_url_filter": (op1_url_filter, None),
    "op2_substring_dedup": (op2_substring_dedup, None),
    "op3_pseudonyms": (op3_pseudonyms, None),
    "op4_near_dedup": (op4_near_dedup, None),
    "op5_html_text": (op5_html_text, None),
    "op6_line_dedup": (op6_line_dedup, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_decontaminate": (op8_decontaminate, None),
    "op9_topk": (op9_topk, TOP_K_SQL),
    "op10_packing": (op10_packing, None),
    "op11_hard_negatives": (op11_hard_negatives, NEGATIVES_SQL),
    "op12_token_files": (op12_token_files, None),
    "op13_ranked_terms": (op13_ranked_terms, RANKED_SQL),
}
