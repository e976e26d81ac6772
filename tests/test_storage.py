"""What finished steps leave on disk."""

import os

import pytest
from pyspark.sql import functions as F

from mailsift import storage
from mailsift.operators import bm25, generations, ngrams
from mailsift.storage import FREES_SHUFFLES, drop, materialise, new_path


def names(folder):
    return {x.rsplit("-", 1)[0] for x in os.listdir(folder)}


def shuffled(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {b.toString() for b in (manager.getAllBlocks().apply(i) for i in range(manager.getAllBlocks().size())) if b.isShuffle()}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, setting = shuffled(spark), spark.conf.get(FREES_SHUFFLES)
    stored = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "storage-test")
    assert stored.count() == 7 and spark.conf.get(FREES_SHUFFLES) == setting
    left = [x for x in shuffled(spark) - before if "data" in x]
    assert len(left) <= 1  # that of the count above


@pytest.fixture()
def own_dir(monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    return tmp_path


def mails(spark):
    return spark.createDataFrame([(str(i), f"subject {i}", f"customs vessel {i % 3}") for i in range(20)],
                                 "no string, subject string, plaintextbody string")


def test_a_written_index_leaves_no_words(spark, own_dir):
    built = bm25.build_index(mails(spark))
    bm25.write_index(built, new_path(spark, "index"), buckets=2)
    bm25.release(built)
    assert "mail-words" not in names(own_dir)


def test_generations_leave_no_tables_of_their_build(spark, own_dir):
    path = new_path(spark, "made")
    generations.create(mails(spark), path, buckets=2, parts=2)
    generations.update(spark, path, mails(spark).where("no < '2'"), mails(spark).where("no = '7'"))
    assert not {x for x in names(own_dir) if x.startswith("generation-") or x == "mail-words"}
    assert generations.read(spark, path).docs.count() == 19


def test_gram_texts_are_written_once(spark, own_dir):
    texts = mails(spark).select(F.col("no").alias("key"), F.lit("subject").alias("field"), F.col("subject").alias("text"))
    path = new_path(spark, "grams")
    ngrams.write_grams(texts, path, buckets=2, parts=2)
    assert "gram-texts" not in names(own_dir)
    index, asked = ngrams.read_grams(spark, path), spark.createDataFrame([("subject 7",), ("ct",)], "term string")
    assert index.texts.count() == 20 and ngrams.find_terms(index, asked).count() == 21
    # A batch that was cut short does not count, and is written again.
    drop(spark, f"{path}/batches")
    ngrams._append(spark, ngrams._texts(texts, ("lower",)), path, 2, 2)
    assert ngrams.find_terms(ngrams.read_grams(spark, path), asked).count() == 21
