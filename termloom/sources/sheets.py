"""Tagging and review sheets: CSV with a header, all text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.schemas import SHEET_COLUMNS

OPTIONAL = ("intent", "notes")
#: Distance of two files' first places, as of two partitions in Spark's own row numbers.
ROWS_OF_A_FILE = 1 << 33


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Columns by header name; missing values, and the columns intent and notes, become ''.

    Quotes are doubled and a value may hold line breaks, so each file is read by one task;
    sheets written by this package come in files of bounded size. ``ord`` is the place of a
    row in reading order: its file, then its place in the file (Spark reads files in any
    order, but one file front to back).
    """
    raw = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    absent = [n for n in SHEET_COLUMNS if n not in raw.columns and n not in OPTIONAL]
    if absent:
        raise ValueError(f"sheet {path} lacks the columns {absent}")
    columns = {
        name: F.coalesce(F.col(name), F.lit("")) if name in raw.columns else F.lit("")
        for name in SHEET_COLUMNS
    }
    extra = [name for name in raw.columns if name not in SHEET_COLUMNS]
    # files in the order of their names, which are few beside their rows; a file is one task front to back
    names = raw.select(F.col("_metadata.file_path").alias("_file")).distinct()
    files = names.withColumn("_at", F.row_number().over(Window.orderBy("_file")).cast("long"))
    placed = raw.withColumns(columns).select(
        *SHEET_COLUMNS, *extra, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id")
    )
    first = placed.groupBy("_file").agg(F.min("_id").alias("_first"))
    at = F.col("_at") * F.lit(ROWS_OF_A_FILE) + F.col("_id") - F.col("_first")
    return placed.join(files.join(first, "_file"), "_file").select(*SHEET_COLUMNS, *extra, at.alias("ord"))
