"""The index with blocks: one task per file, however few the session's shuffle has."""

from pyspark.sql import functions as F

from mailsift.operators import block_bounds, bm25
from mailsift.storage import new_path


def test_tasks_grow_with_the_mails(spark, monkeypatch):
    monkeypatch.setattr(bm25, "DOCS_PER_FILE", 1)
    many = spark.range(60).select(F.col("id").cast("string").alias("no"), F.lit("customs port").alias("plaintextbody"))
    path = new_path(spark, "blocks")
    block_bounds.write_blocks(bm25.build_index(many), path, buckets=4, block_docs=2)
    stored = spark.read.parquet(f"{path}/postings")
    files = stored.select(F.input_file_name().alias("file")).distinct()
    writers = files.select(F.regexp_extract("file", r"part-(\d+)", 1).alias("task")).distinct().count()
    assert writers > 8 and stored.count() == 120
    asked = spark.createDataFrame([(1, "customs port")], "query_id long, query_text string")
    assert block_bounds.search_blocks(block_bounds.read_blocks(spark, path), asked, 60).count() == 60
