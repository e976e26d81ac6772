"""Checking delivered files against a manifest (path, sha256, max_bytes)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Larger files are not held in memory; Spark's reader cannot hold more than 2 GB at all.
HELD_BYTES = 64 << 20
#: Larger files that are read at the same time.
STREAMS = 4


def delivered_files(spark: SparkSession, path: str, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Size and SHA-256 of every file.

    Files of up to `held_bytes` are hashed by the tasks that read them.  Larger ones, whose paths are collected, are read as
    streams by the driver, a few at a time and a few KB of each in memory: a checksum of a file cannot be shared out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = F.regexp_extract("path", "([^/]+)$", 1).alias("name")
    small = files.where(F.col("length") <= held_bytes).select(
        named, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > held_bytes).select(named, "length", "path").collect()
    if not large:
        return small
    with ThreadPoolExecutor(STREAMS) as pool:
        sums = list(pool.map(lambda row: _streamed_sha256(spark, row["path"]), large))
    rows = [(row["name"], row["length"], value) for row, value in zip(large, sums)]
    return small.unionByName(spark.createDataFrame(rows, "name string, bytes long, sha256 string"))


def _streamed_sha256(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def violations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row (name, problem) per broken rule; a clean delivery gives no rows."""
    wanted = manifest.select("name", F.lower(F.trim("sha256")).alias("wanted"), "max_bytes")
    checked = wanted.join(files, "name", "left")
    rules = [
        (F.coalesce("bytes", F.lit(0)) == 0, "missing or empty"),  # Spark lists no empty files
        ((F.col("max_bytes") > 0) & (F.col("bytes") > F.col("max_bytes")), "too large"),
        (F.coalesce(F.col("wanted"), F.lit("")) == "", "no checksum given"),
        ((F.col("wanted") != "") & (F.col("sha256") != F.col("wanted")), "checksum differs"),
    ]
    problems = F.array_compact(F.array(*[F.when(broken, text) for broken, text in rules]))
    return checked.select("name", F.explode(problems).alias("problem"))


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    return [name for name in names if not spark.catalog.tableExists(name)]
