"""Exact consecutive numbers per group without one task per group."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.fixed_values import INTEREST_BATCH_SIZE
from termloom.session import stored


def whole_quotient(number: Column, by: int) -> Column:
    """Whole-number division; a quotient of doubles would be off beyond 2**53."""
    return F.call_function("div", number, F.lit(by))


def numbered(rows: DataFrame, group: list[str], order: str, name: str = "row_no") -> DataFrame:
    """Add the 0-based position of a row inside its group, by a unique ``order``.

    A group may hold any share of the rows and its order may have gaps of any width, so the rows are cut into
    ranges of (group, order) of like size and written once with their range's number. Rows are counted per
    group and range, the counts are summed up along the ranges of a group, which are as many as there are partitions,
    and a row's position is its range's start plus its position inside the range. A missing group is a group.
    """
    ranged = rows.repartitionByRange(*group, order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "numbered")
    along = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    keys = [*group, "_range"]
    starts = (
        ranged.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(key).alias(f"_of_{key}") for key in keys], (F.sum("_n").over(along) - F.col("_n")).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    return (
        ranged.withColumn("_inside", inside)
        .join(starts, functools.reduce(Column.__and__, same))
        .withColumn(name, F.col("_start") + F.col("_inside") - 1)
        .select(*rows.columns, name)
    )


def batch_number(position: Column, size: int = INTEREST_BATCH_SIZE) -> Column:
    return whole_quotient(position, size)


def assign_batches(
    keywords: DataFrame, group: list[str], order: str = "id", size: int = INTEREST_BATCH_SIZE
) -> DataFrame:
    """Consecutive batches of ``size`` keywords per group, in scan order."""
    placed = numbered(keywords, group, order, "_at")
    return placed.withColumn("batch", batch_number(F.col("_at"), size)).drop("_at")
