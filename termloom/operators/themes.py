"""Theme of a keyword by its seed, and routing of tagged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.fixed_values import DEFAULT_THEME, INTENT_EXCLUDED, THEME_PREFIXES
from termloom.functions.text import code
from termloom.operators.language import resolved_language

MATCHING = "matching"
CROSS_LANGUAGE = "cross_language"


def theme_of_seed(
    seed: Column,
    prefixes: list[tuple[str, str]] = THEME_PREFIXES,
    default: str = DEFAULT_THEME,
) -> Column:
    """Theme of the first prefix in list order that the lower-cased seed starts with."""
    lowered = F.lower(seed)
    themes = [F.when(lowered.startswith(prefix), theme) for prefix, theme in prefixes]
    return F.coalesce(*themes, F.lit(default))


def route_tagged(
    sheet: DataFrame,
    target_lang: str | None = None,
    prefixes: list[tuple[str, str]] = THEME_PREFIXES,
) -> DataFrame:
    """Tagged rows with resolved ``lang``, ``cluster`` and ``route``.

    Rows without tag or tagged as excluded are left out. A row whose resolved language is
    not its declared one is routed as cross-language; a declared code in upper case counts
    as such without an override, because the resolved code keeps its case. The others match
    when their language is the target (or no target is given) and are left out otherwise.
    """
    declared = F.coalesce(F.col("lang"), F.lit(""))
    resolved = resolved_language(declared, F.col("notes"))
    is_match = F.lit(True) if target_lang is None else (
        F.col("_resolved") == code(F.lit(target_lang))
    )
    return (
        sheet.withColumn("intent", code(F.col("intent")))
        .where(~F.col("intent").isin("", INTENT_EXCLUDED))
        .withColumns(
            {
                "notes": F.coalesce(F.col("notes"), F.lit("")),
                "cluster": theme_of_seed(F.col("seed"), prefixes),
                "_resolved": resolved,
            }
        )
        .withColumn(
            "route",
            F.when(F.col("_resolved") != code(declared), CROSS_LANGUAGE).when(is_match, MATCHING),
        )
        .where(F.col("route").isNotNull())
        .withColumn("lang", F.col("_resolved"))
        .drop("_resolved")
    )
