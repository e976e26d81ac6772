"""Loading only what is new, and folding staged values into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import keep_first


def new_rows(incoming: DataFrame, held: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows whose key the table does not hold, one per key; rows without a key are never taken."""
    fresh = incoming.where(F.col(key).isNotNull()).join(held.select(key), key, "left_anti")
    return keep_first(fresh, [key], order)


def update_column(table: DataFrame, staged: DataFrame, key: str, column: str) -> DataFrame:
    """The table with staged values where there are any and its own values elsewhere.

    A key that is staged several times counts once, with its largest value, so the table keeps its rows.
    """
    values = staged.where(F.col(column).isNotNull()).groupBy(key).agg(F.max(column).alias("_staged"))
    old = F.col(column) if column in table.columns else F.lit(None).cast(staged.schema[column].dataType)
    joined = table.join(values, key, "left").withColumn(column, F.coalesce("_staged", old)).drop("_staged")
    return joined.select(*dict.fromkeys([*table.columns, column]))
