"""Orders, top-k cuts, ranks and score scaling, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import id_number, timestamp
from ..storage import materialise
from .joins import join_spread


def newest_first(time: str = "deliverytime", key: str = "no") -> list[Column]:
    return [timestamp(F.col(time)).desc_nulls_last(), id_number(F.col(key)).desc_nulls_last()]


def oldest_first(time: str = "deliverytime", key: str = "no") -> list[Column]:
    return [timestamp(F.col(time)).asc_nulls_last(), id_number(F.col(key)).asc_nulls_last()]


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first `k` rows of each group.

    Spark cuts every partition to `k` rows per group before the shuffle, so a group of any size costs one sort
    per task and sends at most `k` rows per task.
    """
    position = rank or "_position"
    window = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn(position, F.row_number().over(window)).where(F.col(position) <= k)
    return cut if rank else cut.drop(position)


def keep_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the one with the smallest `order`.

    An aggregate, not a window: rows of one key are reduced inside every task before they meet.
    """
    names = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*names), order).alias("_row"))
    return best.select(*keys, *[F.col("_row")[n].alias(n) for n in names]).select(*df.columns)


def position_in_group(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column | None, name: str, size: str | None = None
) -> DataFrame:
    """1-based position of each row in its group, and the size of the group if wanted, for groups of any size.

    A position is the number of rows in lower buckets of the group plus the position inside the bucket, so no task ever
    sorts a whole group.  `bucket` must never fall as `order` rises; without one the buckets are ranges of the order.
    """
    df = _ranges(df, keys, order) if bucket is None else df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_n").over(Window.partitionBy(*keys)).alias(size)] if size else []
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), *whole)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    joined = _join_null_safe(df, offsets, [*keys, "_bucket"])
    return joined.withColumn(name, F.col("_offset") + F.row_number().over(inside)).drop("_bucket", "_offset")


def _ranges(df: DataFrame, keys: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """Add `_bucket`, the number of the row's range in the order of keys and `order`, and write the table.

    Spark draws the cuts from the data, so ranges are even however values are spread, and a large group has many.  The
    table is written because another draw would give other cuts.
    """
    parts = [] if ranges is None else [ranges]
    cut = df.repartitionByRange(*parts, *[F.col(k) for k in keys], *order)
    return materialise(cut.withColumn("_bucket", F.spark_partition_id()), "ranges")


def running_count(counts: DataFrame, keys: list[str], order: list[Column], count: str, name: str,
                  total: str | None = None, ranges: int | None = None) -> DataFrame:
    """Add `name`, the sum of `count` over the earlier rows of the group, and `total`, the sum over all, if wanted.

    For groups of any size: only the rows of one range are sorted together, and earlier ranges count as a whole.
    """
    counts = _ranges(counts, keys, order, ranges)
    sizes = counts.groupBy(*keys, "_bucket").agg(F.sum(count).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_size").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"), *whole)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("_offset") + F.coalesce(F.sum(count).over(inside), F.lit(0))
    return _join_null_safe(counts, offsets, [*keys, "_bucket"]).withColumn(name, earlier).drop("_bucket", "_offset")


def competition_rank(
    df: DataFrame, keys: list[str], value: str, name: str, ascending: bool = False, buckets: int | None = None,
    spread: str = "no",
) -> DataFrame:
    """Rank with equal values sharing the lowest rank; NULL values get no rank.  For groups of any size.

    Rows are counted per value first, so ties collapse before the shuffle.  See `running_count` for `buckets`.
    """
    signed = F.col(value) if ascending else -F.col(value)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, signed.alias("_value")).agg(F.count("*").alias("_n"))
    counts = running_count(counts, keys, [F.col("_value")], "_n", "_before", ranges=buckets)
    ranks = counts.select(*keys, (F.col("_value") if ascending else -F.col("_value")).alias(value),
                          (F.col("_before") + 1).alias(name), "_n")
    return join_spread(df, ranks, [*keys, value], spread, rows="_n", how="left")


def scale_min_max(df: DataFrame, keys: list[str], value: str, name: str, spread: str = "no") -> DataFrame:
    """Values scaled to 0..1 inside each group, NULL as 0; a constant group gives 1, or 0 if the constant is 0.

    The two ends come from a partial aggregate and are joined back, so a large group is never gathered.
    """
    filled = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    ends = df.groupBy(*keys).agg(F.min(filled).alias("_low"), F.max(filled).alias("_high"), F.count("*").alias("_n"))
    scaled = (
        F.when(F.col("_high") > F.col("_low"), (filled - F.col("_low")) / (F.col("_high") - F.col("_low")))
        .otherwise(F.when(F.col("_high") != 0, 1.0).otherwise(0.0)))
    return join_spread(df, ends, keys, spread, rows="_n").withColumn(name, scaled).drop("_low", "_high")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])
