"""Landed interest series: wide files, one numeric column per keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.interest import unpivot_interest


def read_interest(
    spark: SparkSession, path: str, date: str = "date", partial: str = "isPartial"
) -> DataFrame:
    """Long form (date, batch, keyword, value) of all landed Parquet batches below a folder.

    Batches hold different keywords, so their columns are merged, and a keyword has rows only in a batch
    that holds a value of it. ``batch`` is the number of a folder ``batch=<n>``; without such folders it is the path of a file's
    folder, so that later names are later batches. Only which batch holds which keyword is broadcast, one row per column of a
    batch, so the series stay where they are read and no task gathers those of a keyword.
    """
    wide = spark.read.option("mergeSchema", True).parquet(path)
    if "batch" not in wide.columns:
        wide = wide.withColumn("batch", F.regexp_replace("_metadata.file_path", "/[^/]*$", ""))
    long = unpivot_interest(wide, date, partial, ["batch"])
    held = long.where(F.col("value").isNotNull()).select("batch", "keyword").distinct()
    return long.join(F.broadcast(held), ["batch", "keyword"], "left_semi").select(date, "batch", "keyword", "value")


def read_interest_lines(
    spark: SparkSession, path: str, date: str = "date", partial: str = "isPartial"
) -> DataFrame:
    """Long form (date, batch, keyword, value) of landed JSON lines, one per date, with one field per keyword.

    A line is read as one variant value and unfolded where it stands, so schemas of different batches never meet and the files
    are read once; each field becomes one row. ``batch`` is the number of a folder ``batch=<n>`` and 0 without one. A missing
    value stays as a row, so that a batch that holds a keyword with missing values only still counts as its last one.
    Values that are no number are missing; a line that is no object gives no row.
    """
    number = F.try_to_number(F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/[^/]*$", 1), F.lit("9" * 18))
    lines = spark.read.option("singleVariantColumn", "line").json(path).select(
        "line", F.coalesce(number.cast("long"), F.lit(0)).alias("batch")
    )
    at = F.try_variant_get("line", f"$['{date}']", "string").try_cast("timestamp_ntz")
    fields = lines.lateralJoin(spark.tvf.variant_explode(F.col("line").outer()))
    return fields.where(~F.col("key").isin(date, partial)).select(
        at.alias(date), "batch", F.col("key").alias("keyword"), F.try_variant_get("value", "$", "double").alias("value")
    )
