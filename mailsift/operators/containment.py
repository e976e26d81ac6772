"""Which of many texts hold which of many terms, as substrings."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..storage import materialise

TERMS_PER_SCAN = 200_000


def _term_finder(terms: list[str]):
    """A function from a text to the numbers of the terms it holds."""
    machine = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        machine.add_word(term, i)
    machine.make_automaton()
    return lambda text: {i for _, i in machine.iter(text)}


def find_terms(texts: DataFrame, terms: DataFrame, terms_per_scan: int = TERMS_PER_SCAN) -> DataFrame:
    """All pairs (key, field, term) where the text holds the term, ignoring case.

    `texts` has (key, field, text), `terms` has (term).  Each text is read once per scan and meets all terms at the
    same time, so the work grows with the text and the hits, not with texts x terms.  A scan carries at most
    `terms_per_scan` terms; more terms are shared out by hash over several scans, none is left out.
    """
    terms = materialise(terms.select(F.lower("term").alias("term")).where(F.col("term") != "").distinct(), "terms")
    scans = -(-terms.count() // terms_per_scan) or 1
    parts = [_scan(texts, terms.where(F.pmod(F.xxhash64("term"), F.lit(scans)) == i)) for i in range(scans)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _scan(texts: DataFrame, terms: DataFrame) -> DataFrame:
    spark = texts.sparkSession
    wanted = spark.sparkContext.broadcast([row.term for row in terms.collect()])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = wanted.value
        find = _term_finder(names)
        for batch in batches:
            hits = [(key, field, names[i]) for key, field, text in zip(batch.key, batch.field, batch.text)
                    for i in find(text)] if names else []
            yield pd.DataFrame(hits, columns=["key", "field", "term"]).astype("object")

    lowered = texts.where(F.col("text").isNotNull()).select(
        F.col("key").cast("string").alias("key"), "field", F.lower("text").alias("text"))
    return lowered.mapInPandas(scan, "key string, field string, term string")


def text_fields(df: DataFrame, key: str, fields) -> DataFrame:
    """One row (key, field, text) per filled field."""
    present = [f for f in fields if f in df.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in present])
    return (df.select(F.col(key).alias("key"), F.explode(pairs).alias("pair"))
            .select("key", "pair.field", "pair.text").where(F.col("text").isNotNull()))
