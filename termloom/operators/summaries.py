"""Counts for reports. All group keys here have few values; counts are aggregated partially."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.fixed_values import INTENT_COMMERCIAL


def count_by(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Rows per value, most first; ties keep the order of first appearance."""
    return (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_ord"))
        .orderBy(F.desc("n"), "first_ord")
    )


def curation_counts(curated: DataFrame) -> DataFrame:
    """Total, kept, competitor, off-topic and foreign rows in one pass."""
    bucket = F.col("bucket")
    return curated.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(bucket == "keeper").alias("kept"),
        F.count_if(bucket == "competitor").alias("competitor"),
        F.count_if(bucket == "off_topic").alias("off_topic"),
        F.count_if(bucket == "foreign").alias("foreign_language"),
    )


def classification_rate(classified: DataFrame) -> DataFrame:
    """Share of classified rows in percent (0 without rows) and the number of commercial ones."""
    done, total = F.count("intent"), F.count(F.lit(1))
    return classified.agg(
        total.alias("total"),
        done.alias("classified"),
        (total - done).alias("needs_review"),
        F.coalesce(F.try_divide(done.cast("double"), total.cast("double")) * 100, F.lit(0.0))
        .alias("auto_rate"),
        F.count_if(F.col("intent") == INTENT_COMMERCIAL).alias("commercial"),
    )


def ingest_counters(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Suggestions and newly stored ones per expanded seed, of rows marked by ``keyed.marked_new``."""
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("suggestions"), F.count_if("is_new").alias("inserted")
    )
