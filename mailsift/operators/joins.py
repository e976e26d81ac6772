"""Joins of a table of queries with large tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import materialise

SMALL_ROWS = 200_000
ROWS_PER_TASK = 1_000_000
SALTS = 16


def is_small(df: DataFrame, limit: int = SMALL_ROWS) -> bool:
    """Whether the table has at most `limit` rows.  Counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def join_small(
    large: DataFrame, small: DataFrame, keys: list[str], spread: str, limit: int = SMALL_ROWS
) -> DataFrame:
    """Inner join that does not shuffle the large table while the other side has at most `limit` rows.

    Beyond that, the small table is repeated once per salt and the large one takes its salt from the `spread` column,
    so the rows of one frequent key are shared out over several tasks.
    """
    if is_small(small, limit):
        return large.join(F.broadcast(small), keys)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
            .join(salted, [*keys, "_salt"]).drop("_salt"))


def join_spread(
    large: DataFrame, counted: DataFrame, keys: list[str], spread: str, rows: str, how: str = "inner"
) -> DataFrame:
    """Join of a large table, whose keys may be very uneven, with a table that knows how uneven.

    The column `rows` of `counted` says how many rows the large table has for the key.  Keys with more than
    `ROWS_PER_TASK` rows are repeated and their rows shared out; all other keys meet as in any join.  There are at most
    (rows of the large table / ROWS_PER_TASK) such keys.
    """
    counted = materialise(counted, "counted")
    salts = (1 + F.floor(F.col(rows) / ROWS_PER_TASK)).cast("int").alias("_salts")
    heavy = counted.where(F.col(rows) > ROWS_PER_TASK).select(*keys, salts).distinct()
    if heavy.isEmpty():
        return large.join(counted.drop(rows), keys, how)
    heavy = F.broadcast(heavy) if is_small(heavy) else heavy
    parts = F.coalesce("_salts", F.lit(1))
    left = large.join(heavy, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
    right = counted.drop(rows).join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"], how).drop("_salt")
