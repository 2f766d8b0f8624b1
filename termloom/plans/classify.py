"""Classify a tagging sheet, group it by theme, and diagnose what stays open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.diagnostics import matched_categories
from termloom.operators.intent import ALL_TIERS, CONFIDENT, auto_classify
from termloom.operators.themes import CROSS_LANGUAGE, MATCHING, route_tagged
from termloom.session import stored
from termloom.sinks import reports


def write_classification(
    sheet: DataFrame, folder: str, lang: str, include_commercial: bool = False
) -> DataFrame:
    """Write the classified list and, where rows are left, the review list."""
    result = stored(
        auto_classify(sheet, ALL_TIERS if include_commercial else CONFIDENT), "classified"
    )
    done, left = F.col("intent").isNotNull(), F.col("intent").isNull()
    reports.CLASSIFIED.write(result.where(done), f"{folder}/classified_{lang}")
    if not result.where(left).isEmpty():
        reports.NEEDS_REVIEW.write(result.where(left), f"{folder}/needs_review_{lang}")
    return result


def write_clusters(sheet: DataFrame, folder: str, lang: str) -> DataFrame:
    """Write the clustered list and, where there are any, the corrected-language list.

    Takes a tagging sheet filled in by hand or the output of ``auto_classify``.
    """
    routed = stored(route_tagged(sheet, lang), "clustered")
    reports.CLUSTERED.write(routed.where(F.col("route") == MATCHING), f"{folder}/clustered_{lang}")
    cross = routed.where(F.col("route") == CROSS_LANGUAGE)
    if not cross.isEmpty():
        reports.CROSS_LANGUAGE.write(cross, f"{folder}/cross_language_from_{lang}")
    return routed


def write_diagnosis(review: DataFrame, folder: str, lang: str) -> DataFrame:
    """Write the no-match and the conflict list where they are not empty."""
    routed = stored(matched_categories(review), "diagnosed")
    for route, report in [("no_match", reports.NO_MATCH), ("conflict", reports.CONFLICTS)]:
        rows = routed.where(F.col("route") == route)
        if not rows.isEmpty():
            report.write(rows, f"{folder}/diagnostic_{route}_{lang}", tie=None)
    return routed
