"""Scores by season and by month: long form and one row per keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.fixed_values import CYCLONE_SEASON, HIGH_SEASON, MONTH_LABELS
from termloom.functions.calendar import in_cyclone_season, season_of_month
from termloom.functions.numbers import rounded_mean


def season_average(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean over all rows of a season; a season without rows has no row."""
    season = season_of_month(F.col("month")).alias("season")
    return scores.groupBy(*(keys or ["keyword"]), season).agg(
        rounded_mean(F.col("interest_score")).alias("score")
    )


def season_summary(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per keyword with both seasons, 0 for a season without rows; a single shuffle."""
    score, cyclone = F.col("interest_score"), in_cyclone_season(F.col("month"))
    return scores.groupBy(*(keys or ["keyword"])).agg(
        F.coalesce(rounded_mean(F.when(~cyclone, score)), F.lit(0.0)).alias(HIGH_SEASON),
        F.coalesce(rounded_mean(F.when(cyclone, score)), F.lit(0.0)).alias(CYCLONE_SEASON),
    )


def monthly_matrix(
    scores: DataFrame, keys: list[str] | None = None, order: str = "ord"
) -> DataFrame:
    """One row per keyword with 12 months: the last score of a month, 0 for a missing month.

    Twelve conditional ``max_by`` share one partial hash aggregation and one shuffle, where
    a pivot would shuffle by month first.
    """
    months = []
    for number, label in enumerate(MONTH_LABELS, start=1):
        here = F.col("month") == number
        last = F.max_by(F.when(here, F.col("interest_score")), F.when(here, F.col(order)))
        months.append(F.coalesce(last, F.lit(0.0)).alias(label))
    return scores.groupBy(*(keys or ["keyword"])).agg(*months)
