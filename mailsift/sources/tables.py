"""Reading exports and listings, cleaning them, and writing results."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions.clean import id_key, real_null


def clean_names(names: list[str]) -> list[str]:
    """Column names in lower case with `_` for everything else; a number is added where two would be equal."""
    result: list[str] = []
    for name in names:
        clean = re.sub(r"\W+", "_", str(name)).strip("_").lower() if name else "col_unknown"
        result.append(clean if clean not in result else f"{clean}_{len(result) + 1}")
    return result


def read_export(spark: SparkSession, path: str | list[str], title_rows: int = C.TITLE_ROWS, sep: str = ",",
                header_path: str | None = None) -> DataFrame:
    """A CSV export with title rows above its header: every column text, blank rows dropped.

    `path` is one file, or several files and folders of rows alone; then the header is in the file `header_path`, one of
    them.  Cells may hold line breaks, so a file is read by one task: a large export comes in many files.  Only the first
    lines come to the driver, to learn the names.  Title and header rows are told by their number in their file.
    """
    header_path = header_path or (path if isinstance(path, str) else path[0])
    lines = [row.value for row in spark.read.text(header_path).head(title_rows + 1)]
    names = clean_names(next(csv.reader([lines[title_rows]], delimiter=sep)))

    def rows(source) -> DataFrame:
        return spark.read.csv(source, schema=", ".join(f"`{n}` string" for n in names), sep=sep, quote='"', escape='"',
                              multiLine=True)

    # Empty lines are no rows.  The header file is read by itself, so its rows are numbered from 0.
    above = sum(line != "" for line in lines)
    first = rows(header_path).withColumn("_row", F.monotonically_increasing_id()).where(F.col("_row") >= above).drop("_row")
    others = [p for p in ([path] if isinstance(path, str) else path) if p != header_path]
    return drop_blank_rows(first.unionByName(rows(others)) if others else first)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Rows where at least one cell holds a value."""
    return df.na.drop(how="all")


def normalise(df: DataFrame, id_columns: tuple[str, ...] = ("no", "month")) -> DataFrame:
    """Real NULLs for blank and missing-value texts; ids and months without a `.0` tail.

    One projection at ingest, so that every later operator joins and filters on plain values.
    """
    def clean(name: str, kind: str):
        if kind != "string":
            return F.col(name)
        value = real_null(F.col(name))
        return id_key(value).alias(name) if name in id_columns else value.alias(name)

    return df.select([clean(name, kind) for name, kind in df.dtypes])


def select_present(df: DataFrame, columns=C.RESULT_COLUMNS, optional=C.OPTIONAL_COLUMNS) -> DataFrame:
    """The result columns, and those optional ones that the table has."""
    return df.select(*columns, *[c for c in optional if c in df.columns])


def append_mail(df: DataFrame, path: str) -> None:
    """Append clean mail to a table partitioned by month.  Rebalancing gives months of any size files of one size."""
    df.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """A CSV folder, with a header in each file.  Cells keep their spaces and line breaks (read them with `multiLine`)."""
    df.write.mode("overwrite").csv(path, header=header, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def load_profile(mail: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and, for each column, how many rows are filled: one pass over the table."""
    measures = [F.count("*").alias("rows")] + [F.count(c).alias(f"filled_{c}") for c in columns]
    return mail.agg(*measures)


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def has_values(df: DataFrame, column: str) -> bool:
    """Whether the column exists and any row fills it."""
    return column in df.columns and not df.where(F.col(column).isNotNull()).limit(1).isEmpty()
