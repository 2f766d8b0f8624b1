"""Season of a month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.fixed_values import CYCLONE_MONTHS, CYCLONE_SEASON, HIGH_SEASON


def in_cyclone_season(month: Column) -> Column:
    return F.coalesce(month.between(*CYCLONE_MONTHS), F.lit(False))


def season_of_month(month: Column) -> Column:
    """January to March is the cyclone season; every other number counts as high season."""
    return F.when(in_cyclone_season(month), CYCLONE_SEASON).otherwise(HIGH_SEASON)
