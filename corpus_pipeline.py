"""A training-data pipeline over the documents table, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from mailsift.llm import decontaminate, fuzzy_lines, near_dedup, packing, queries, toxicity  # noqa: E402
from mailsift.storage import materialise  # noqa: E402


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    queries.bounded(spark)
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike the first stays; documents stay, if need be without text."""
    queries.bounded(spark)
    kept = fuzzy_lines.dedup_lines(docs).drop("n_lines", "n_removed")
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: sets of five-word shingles, similarity 0.8 or more."""
    queries.bounded(spark)
    judged = near_dedup.near_duplicates(docs.select("doc_id", "text"), size=5)
    gone = judged.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    queries.bounded(spark)
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    queries.bounded(spark)
    return packing.pack(docs.select("doc_id", "text"), queries.vocabulary())


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("near dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: SQL cannot express the model, the fuzzy links and the tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ENTRIES = {"pipeline": (run, ORACLE_SQL)}
