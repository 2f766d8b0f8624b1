"""Curate stored keywords: noise out, foreign languages apart, the rest to a tagging sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.evaluate import with_evaluated
from termloom.functions.rules import RuleTable
from termloom.operators.language import MARKERS, detected_language
from termloom.operators.noise import KEEP, NOISE, route_noise
from termloom.session import stored
from termloom.sinks import reports

FOREIGN = "foreign"


def curate(
    keywords: DataFrame,
    declared: Column | str,
    noise: RuleTable = NOISE,
    markers: RuleTable = MARKERS,
) -> DataFrame:
    """Add ``bucket`` (keeper, foreign, competitor, off_topic) and ``detected_lang``.

    Only kept keywords are looked at for their language.
    """
    declared = declared if isinstance(declared, Column) else F.lit(declared)
    detected = F.when(F.col("bucket") == KEEP, detected_language(F.col("keyword"), markers))
    is_foreign = F.col("detected_lang").isNotNull() & ~F.col("detected_lang").eqNullSafe(declared)
    routed = route_noise(keywords, noise)
    return (
        with_evaluated(routed, "detected_lang", detected)
        .withColumn("bucket", F.when(is_foreign, FOREIGN).otherwise(F.col("bucket")))
    )


def write_curation(curated: DataFrame, folder: str, lang: str, tie: str = "id") -> DataFrame:
    """Write the tagging sheet and, where there is one, the foreign list."""
    curated = stored(curated, "curated")
    kept = curated.where(F.col("bucket") == KEEP)
    reports.TAGGING_SHEET.write(kept, f"{folder}/to_tag_{lang}", tie=tie)
    foreign = curated.where(F.col("bucket") == FOREIGN)
    if not foreign.isEmpty():
        reports.FOREIGN_LANGUAGE.write(foreign, f"{folder}/foreign_language_from_{lang}", tie=tie)
    return curated
