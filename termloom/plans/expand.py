"""Expand: landed answers to new stored keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame

from termloom.fixed_values import SUGGESTION_SOURCE
from termloom.operators.keyed import first_spelling
from termloom.sinks.tables import append_keywords
from termloom.sources.suggestions import decode_suggestions

EXPANSION = ["lang", "root_seed"]


def expand(payloads: DataFrame, source: str = SUGGESTION_SOURCE) -> DataFrame:
    """Suggestions of all landed answers, deduplicated inside each expansion."""
    return first_spelling(decode_suggestions(payloads, source), EXPANSION)


def expand_into(payloads: DataFrame, path: str, source: str = SUGGESTION_SOURCE) -> int:
    """Append the new keywords to the stored table; returns their number."""
    return append_keywords(expand(payloads, source), path)
