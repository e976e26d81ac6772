"""Continuous loading of mail: clean, keep each id once, append."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.chunking import chunk_table
from ..operators.incremental import new_rows
from ..sources.tables import normalise

#: Tasks that a micro-batch's rows are shared out over by key; each holds its share.
PARTS = 64


def read_landing(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table and stop when everything that has arrived is loaded."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str, time: str) -> StreamingQuery:
    """Append the cleaned rows whose key the table does not hold, one per key and batch, and stop when all is loaded.

    A key is looked up in the whole table, so a row is never too late, whatever the order of times.  Unreadable times
    become NULL and their rows stay.  Each batch writes its own folder `batch=N` over itself: a batch that is run again
    after a failure looks at the other folders only and writes the same rows.
    """
    def load(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        clean = normalise(rows).withColumn(time, F.col(time).try_cast("timestamp"))
        held = spark.read.schema(clean.schema.add("batch", "long")).parquet(path).where(F.col("batch") != batch)
        first = F.coalesce(F.col(time), F.lit("9999-12-31").cast("timestamp"))
        new_rows(clean, held, key, first).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    spark = stream.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return (stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def load_mail(spark: SparkSession, landing: str, schema, mail_path: str, chunk_path: str, checkpoint: str,
              time: str = "arrived", files_per_batch: int = 1000) -> None:
    """Load new mail, then the chunks of the new mail; both can be stopped and started again at any point."""
    landed = read_landing(spark, landing, schema, files_per_batch)
    append_new(landed, mail_path, f"{checkpoint}/mail", "no", time).awaitTermination()
    loaded = spark.readStream.schema(spark.read.parquet(mail_path).schema).parquet(mail_path)
    append_stream(chunk_table(loaded), chunk_path, f"{checkpoint}/chunks").awaitTermination()


def _as_text(column: Column, kind: T.DataType) -> Column:
    return (F.unix_micros(column) if isinstance(kind, T.TimestampType) else column).cast("string")


def _from_text(column: Column, kind: T.DataType) -> Column:
    return F.timestamp_micros(column.cast("long")) if isinstance(kind, T.TimestampType) else column.cast(kind)


def _first_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of every key among the rows of one task, by `_order` and `_tie`."""
    held = list(batches)
    if held:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows, [("_key", "ascending"), ("_order", "ascending"), ("_tie", "ascending")]))
        keys = rows["_key"].combine_chunks()
        new = pc.not_equal(keys.slice(1), keys.slice(0, max(0, len(keys) - 1)))
        first = pa.concat_arrays([pa.array([True] * min(1, len(keys)), pa.bool_()), new])
        yield from rows.filter(first).to_batches(max_chunksize=10_000)


def first_rows(stream: DataFrame, key: str, time: str, parts: int = PARTS) -> DataFrame:
    """The rows of a stream whose key comes for the first time, one per key; `time` must be a timestamp.

    Of rows in one micro-batch the earliest is taken (those without a time last, ties by a hash of the row); rows without
    a key never.  Rows of a key meet in one task of `parts`, which sorts its share of the batch at once; what is left has a
    key once per batch, and Spark drops the keys of earlier batches.  Keys taken are keyed state in the query's checkpoint, so
    a batch looks up its own keys only, however large the table is, and no row is too late.  State is one mark per key and
    never expires: with very many keys the session should name Spark's RocksDB state store.  Columns must be of plain types.
    """
    fields = stream.schema.fields
    odd = [f.name for f in fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if odd:
        raise ValueError(f"columns of a nested or binary type: {', '.join(odd)}")
    # Python sees text only, which keeps every value as it is.
    order = F.coalesce(F.unix_micros(time), F.lit((1 << 63) - 1))
    held = [_as_text(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(fields)]
    asked = stream.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("_key"), order.alias("_order"), F.xxhash64(*[f"`{f.name}`" for f in fields]).alias("_tie"),
        *held)
    first = asked.repartition(parts, "_key").mapInArrow(_first_of_keys, asked.schema).dropDuplicates(["_key"])
    return first.select([_from_text(F.col(f"c{i}"), f.dataType).alias(f.name) for i, f in enumerate(fields)])


def append_by_state(stream: DataFrame, path: str, checkpoint: str, key: str, time: str) -> StreamingQuery:
    """As `append_new`, into a table of its own, by keyed state instead of a look into the table; see `first_rows`."""
    clean = normalise(stream).withColumn(time, F.col(time).try_cast("timestamp"))
    return append_stream(first_rows(clean, key, time), path, checkpoint)
