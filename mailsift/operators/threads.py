"""Mails that belong together: by id, by case, by sender."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.clean import id_key
from ..storage import materialise
from .joins import join_small, join_spread
from .ranking import newest_first, oldest_first, position_in_group, top_k


def lookup_ids(mail: DataFrame, ids: DataFrame, column: str = "no") -> DataFrame:
    """The mails named by a table of ids, which may carry a `.0` tail."""
    wanted = ids.select(id_key(F.col(column).cast("string")).alias("no")).distinct()
    return mail.join(wanted, "no", "left_semi")


def fetch_columns(hits: DataFrame, mail: DataFrame, columns: list[str]) -> DataFrame:
    """Wide columns for the hits only, after all cuts are made."""
    return hits.join(mail.select("no", *columns), "no", "left")


def case_threads(mail: DataFrame) -> DataFrame:
    """Every mail with its place in its case, oldest first.

    Places are counted by ranges of the order, so a case that holds a third of all mail is not sorted in one task,
    whether its mails have a time or not.
    """
    rows = mail.where(F.col("primary_case").isNotNull()).select("primary_case", "no", "deliverytime", "subject",
                                                               "sendername")
    return position_in_group(rows, ["primary_case"], [*oldest_first(), F.col("no")], None, "place")


def case_thread(mail: DataFrame, seeds: DataFrame) -> DataFrame:
    """All mails of the cases of the seed mails, oldest first."""
    cases = mail.join(seeds.select("no"), "no", "left_semi").select("primary_case").distinct()
    rows = join_small(mail, cases.where(F.col("primary_case").isNotNull()), ["primary_case"], spread="no")
    return rows.select("primary_case", "no", "deliverytime", "subject", "sendername").orderBy(
        "primary_case", *oldest_first())


def sender_history(mail: DataFrame, seeds: DataFrame, k: int = C.SENDER_HISTORY) -> DataFrame:
    """For every seed mail, the newest `k` other mails of its sender.

    The newest `k + 1` mails per sender are enough for all seeds of that sender, so the table is cut to those before
    it meets the seeds: a busy sender's mails are never paired with each other.
    """
    asked = materialise(
        mail.join(seeds.select("no"), "no", "left_semi").where(F.col("senderemail").isNotNull())
        .select(F.col("no").alias("seed"), "senderemail"), "seeds")
    counts = asked.groupBy("senderemail").agg(F.count("*").alias("_n"))
    sent = join_small(mail.select("senderemail", "no", "deliverytime", "subject"), counts, ["senderemail"], spread="no")
    history = top_k(sent, ["senderemail"], [*newest_first(), F.col("no")], k + 1, rank="_recent")
    pairs = join_spread(asked, history, ["senderemail"], "seed", rows="_n").where(F.col("no") != F.col("seed"))
    return top_k(pairs, ["seed"], [F.col("_recent")], k, rank="position").drop("_recent")
