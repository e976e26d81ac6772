"""Session settings that the jobs rely on."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Of stored tables a task reads at most so much.  Postings are many times larger in memory than on disk, and a task that
#: deals rows to more than 200 partitions holds all of them, so its memory would grow with the table up to Spark's 128 MB.
READ_BYTES = 16 << 20


def bounded_reads(spark: SparkSession, limit: int = READ_BYTES) -> None:
    """Let tasks of the session read at most `limit` bytes of files, or less if the session says so."""
    key = "spark.sql.files.maxPartitionBytes"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > limit:
        spark.conf.set(key, str(limit))


def builder(name: str = "mailsift") -> SparkSession.Builder:
    """A session builder with the settings; master, memory and shuffle partitions belong to the cluster."""
    made = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    return made


def local(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench."""
    return (builder().master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.driver.memory", memory)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())
