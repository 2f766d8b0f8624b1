"""Seasonality: interest series to stored month scores, and the two score reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.fixed_values import TOP_KEYWORDS
from termloom.operators.interest import monthly_average
from termloom.operators.numbering import assign_batches
from termloom.operators.seasons import monthly_matrix, season_summary
from termloom.sinks import reports
from termloom.sinks.tables import append_scores
from termloom.sources.tables import first_keywords, market_label, read_scores


def interest_requests(keywords: DataFrame, top: int = TOP_KEYWORDS) -> DataFrame:
    """The first stored keywords (id, keyword) with the batch each one is asked in."""
    return assign_batches(first_keywords(keywords.select("id", "keyword"), top), [])


def store_monthly_scores(
    series: DataFrame, path: str, geo: str = "", batch: str | None = None
) -> None:
    """Average a long series (date, keyword, value) by month and append it for a market."""
    append_scores(monthly_average(series, ["keyword"], batch=batch), path, geo)


def export_scores(spark: SparkSession, path: str, folder: str, geo: str = "") -> None:
    """Monthly matrix and season summary of one market."""
    scores, suffix = read_scores(spark, path, geo), market_label(geo)
    reports.MONTHLY.write(monthly_matrix(scores), f"{folder}/seasonality_monthly_{suffix}", tie=None)
    reports.SEASONS.write(season_summary(scores), f"{folder}/seasonality_summary_{suffix}", tie=None)
