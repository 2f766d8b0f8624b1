"""Routing of noise: competitor names first, then off-topic phrases, the rest is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.fixed_values import COMPETITOR, OFF_TOPIC
from termloom.functions.evaluate import with_evaluated
from termloom.functions.rules import RuleTable

NOISE = RuleTable.of({"competitor": COMPETITOR, "off_topic": OFF_TOPIC})
KEEP = "keeper"


def noise_bucket(keyword: Column, table: RuleTable = NOISE) -> Column:
    return F.coalesce(table.first_category(F.lower(keyword)), F.lit(KEEP))


def route_noise(keywords: DataFrame, table: RuleTable = NOISE) -> DataFrame:
    """Add ``bucket``; every row is in exactly one bucket."""
    return with_evaluated(keywords, "bucket", noise_bucket(F.col("keyword"), table))
