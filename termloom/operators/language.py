"""Language of a keyword: detection by marker words, override by notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.fixed_values import LANGUAGE_MARKERS, OVERRIDE_LANGUAGES
from termloom.functions.evaluate import with_evaluated
from termloom.functions.rules import RuleTable
from termloom.functions.text import code

MARKERS = RuleTable.of(LANGUAGE_MARKERS)


def detected_language(keyword: Column, table: RuleTable = MARKERS) -> Column:
    """Language with most distinct markers; null without marker or on a tie at the top."""
    return table.clear_winner(F.lower(keyword))


def split_by_language(
    keywords: DataFrame, declared: Column | str, table: RuleTable = MARKERS
) -> DataFrame:
    """Add ``detected_lang`` and ``is_foreign`` (detected, and other than declared as written)."""
    declared = declared if isinstance(declared, Column) else F.lit(declared)
    detected = F.col("detected_lang")
    return with_evaluated(
        keywords, "detected_lang", detected_language(F.col("keyword"), table)
    ).withColumn("is_foreign", detected.isNotNull() & ~detected.eqNullSafe(declared))


def resolved_language(declared: Column, notes: Column) -> Column:
    """The language code written in the notes, else the declared one unchanged."""
    marker = code(notes)
    return F.when(marker.isin(OVERRIDE_LANGUAGES), marker).otherwise(declared)
