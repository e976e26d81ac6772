"""Attachment files of mails: the map from link key to files, and the links of a mail.

The map is a long table (linkkey, id, title, position, files), one row per file.  A key with very many files is many
rows, never one large row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions.clean import real_null, strip
from .joins import join_spread
from .ranking import keep_first, position_in_group


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Files of many JSON listings: (id, title)."""
    schema = "files array<struct<id string, title string>>"
    listings = spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED")
    return listings.select(F.explode("files").alias("file")).select("file.id", "file.title")


def keyed_files(files: DataFrame) -> DataFrame:
    """(linkkey, id, title) of the files whose title starts with a key; the first title by order is kept."""
    keyed = files.select(F.regexp_extract("title", C.TITLE_KEY, 1).alias("linkkey"), "id", "title")
    keyed = keyed.where((F.col("linkkey") != "") & (F.coalesce("id", F.lit("")) != ""))
    return keyed.groupBy("linkkey", "id").agg(F.min("title").alias("title"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """A hand-made map `{"linkkey": [{"id", "title"}]}` as (linkkey, id, title)."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, array<struct<id string, title string>>>")
    return (text.select(F.explode(entries).alias("linkkey", "items"))
            .select("linkkey", F.explode("items").alias("item")).select("linkkey", "item.id", "item.title"))


def apply_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """Both maps in one; the title of an override wins."""
    ranked = files.withColumn("_order", F.lit(1)).unionByName(overrides.withColumn("_order", F.lit(0)))
    return keep_first(ranked, ["linkkey", "id"], F.struct("_order", "title")).drop("_order")


def link_map(files: DataFrame) -> DataFrame:
    """Add the position of each file in its key, by title, and the number of files of the key."""
    return position_in_group(files, ["linkkey"], [F.col("title"), F.col("id")], None, "position", size="files")


def _url(template: str, file_id: Column) -> Column:
    before, after = template.split("{id}")
    return F.concat(F.lit(before), file_id, F.lit(after))


def with_links(files: DataFrame) -> DataFrame:
    """Add label, view link and download link of each file of a link map."""
    label = F.when(F.col("files") > 1, F.concat(F.lit("PDF part "), F.col("position").cast("string"))).otherwise("PDF")
    file_id = strip(F.col("id"))
    return files.where(file_id != "").select(
        "*", label.alias("label"), _url(C.VIEW_URL, file_id).alias("view_url"),
        _url(C.DOWNLOAD_URL, file_id).alias("download_url"))


def attach(mail: DataFrame, links: DataFrame) -> DataFrame:
    """Every file of every mail by link key; mails without a file keep one row without a link."""
    heads = links.where(F.col("position") == 1).select("linkkey", F.col("files").alias("_n"))
    wanted = mail.select("no", "linkkey").join(heads, "linkkey", "left")
    attached = join_spread(links, wanted.where(F.col("_n").isNotNull()), ["linkkey"], "id", rows="_n")
    return attached.unionByName(wanted.where(F.col("_n").isNull()).drop("_n"), allowMissingColumns=True)


def first_link(mail: DataFrame, links: DataFrame) -> DataFrame:
    """The first file's links per mail."""
    first = links.where(F.col("position") == 1).select("linkkey", "view_url", "download_url")
    return mail.select("no", "linkkey").join(first, "linkkey", "left")


def mentions(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Link keys and file ids in texts, in text order: (key, kind, value, place).

    A whole text may be a key itself, so it comes before the keys found inside it.
    """
    none = F.array().cast("array<string>")
    keys, ids = none, none
    for name in columns:
        text = strip(real_null(F.col(name)))
        keys = F.concat(keys, F.coalesce(F.concat(
            F.array(text), F.regexp_extract_all(text, F.lit("(?U)" + C.LINK_KEY), F.lit(0))), none))
        ids = F.concat(ids, F.coalesce(F.regexp_extract_all(text, F.lit(C.FILE_ID), F.lit(1)), none))

    def rows(kind: str, values: Column) -> DataFrame:
        return df.select(key, F.lit(kind).alias("kind"), F.posexplode(F.array_distinct(values)).alias("place", "value"))

    return rows("key", keys).unionByName(rows("id", ids))


def resolve_links(df: DataFrame, key: str, columns: list[str], links: DataFrame) -> DataFrame:
    """Files of the first mentioned key that has any, else the mentioned file ids themselves, one row per file."""
    found = mentions(df, key, columns)
    known = links.select(F.col("linkkey").alias("value")).distinct()
    hits = found.where(F.col("kind") == "key").join(known, "value")
    first = keep_first(hits.select(key, "value", "place"), [key], F.col("place"))
    by_key = first.withColumnRenamed("value", "linkkey").join(links, "linkkey").select(
        key, "id", "title", F.col("position").cast("long").alias("position"), "files")
    loose = found.where(F.col("kind") == "id").join(first.select(key), key, "left_anti")
    counts = loose.groupBy(key).agg(F.count("*").alias("files"))
    by_id = loose.join(counts, key).select(
        key, F.col("value").alias("id"), F.lit(C.LOOSE_FILE_TITLE).alias("title"),
        (F.col("place") + 1).cast("long").alias("position"), "files")
    return by_key.unionByName(by_id)
