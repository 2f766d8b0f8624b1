"""Evaluate a costly expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_evaluated(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for a costly value.

    A plain column is only an expression: a filter on it is pushed below and computes it
    there once more. The column of a generator is computed in one place, and filters on it stay
    above; the generator here gives exactly one row per row.
    """
    others = [F.col(f"`{other}`") for other in rows.columns if other != name]
    return rows.select(*others, F.explode_outer(F.array(value)).alias(name))
