"""Search intent by prioritised rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom import fixed_values as fixed
from termloom.functions.evaluate import with_evaluated
from termloom.functions.rules import RuleTable
from termloom.functions.text import code
from termloom.operators.keyed import last_value

CONFIDENT_GROUPS = {
    fixed.INTENT_NAVIGATIONAL: fixed.NAVIGATIONAL,
    fixed.INTENT_TRANSACTIONAL: fixed.TRANSACTIONAL,
    fixed.INTENT_INFORMATIONAL: fixed.INFORMATIONAL,
}
COMMERCIAL_GROUPS = {fixed.INTENT_COMMERCIAL: fixed.COMMERCIAL}

CONFIDENT = RuleTable.of(CONFIDENT_GROUPS)
COMMERCIAL = RuleTable.of(COMMERCIAL_GROUPS)
ALL_TIERS = RuleTable.of(CONFIDENT_GROUPS | COMMERCIAL_GROUPS)


def _decided(rows: DataFrame, number: Column, table: RuleTable, existing: Column) -> DataFrame:
    """Add ``intent`` and ``matched_rule`` from the number of the deciding rule."""
    at = F.col("_rule")
    is_tagged = existing != ""
    category, pattern = table.category_of(at), table.pattern_of(at)
    prefix = F.when(category == fixed.INTENT_COMMERCIAL, fixed.RULE_COMMERCIAL_PREFIX).otherwise("")
    return (
        with_evaluated(rows, "_rule", number)
        .withColumns(
            {
                "intent": F.when(is_tagged, existing).otherwise(category),
                "matched_rule": F.when(is_tagged, fixed.RULE_MANUAL).otherwise(
                    F.concat(prefix, pattern)
                ),
            }
        )
        .drop("_rule")
    )


def classify(keywords: DataFrame, table: RuleTable = CONFIDENT) -> DataFrame:
    """Add intent and pattern of the first rule in tier and list order, null where none matches.

    Rules of the tier ``commercial`` are marked by a prefix.
    """
    return _decided(keywords, table.first_hit(F.lower("keyword")), table, F.lit(""))


def auto_classify(sheet: DataFrame, table: RuleTable = CONFIDENT) -> DataFrame:
    """Fill the intent of a tagging sheet; existing tags are kept and marked as manual.

    ``intent`` stays null for rows that need review. Pass ``ALL_TIERS`` to let the
    commercial tier decide what the confident tiers leave open: its rules come last in
    list order, so one pass over the text serves all four tiers. Tagged rows skip the rules.
    """
    existing = code(F.col("intent"))
    number = F.when(existing == "", table.first_hit(F.lower("keyword")))
    return _decided(sheet, number, table, existing)


def tag_map(sheet: DataFrame, order: str = "ord") -> DataFrame:
    """Intent per keyword from the filled rows of a sheet; of repeated keywords the last row counts."""
    return last_value(sheet.withColumn("intent", code(F.col("intent"))), "keyword", "intent", order)


def needs_review(classified: DataFrame) -> DataFrame:
    """Rows no rule decided, with intent and notes blank again."""
    blank = F.lit("")
    return classified.where(F.col("intent").isNull()).withColumns(
        {"intent": blank, "notes": blank}
    )
