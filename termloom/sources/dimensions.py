"""Seed phrases and markets as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.fixed_values import MARKETS, SEEDS


def seed_phrases(spark: SparkSession, lang: str | None = None) -> DataFrame:
    """Seeds (lang, seed, ord) of one language, or of all; an unknown language is a KeyError."""
    chosen = [lang] if lang else list(SEEDS)
    rows = [(code, seed) for code in chosen for seed in SEEDS[code]]
    return spark.createDataFrame(
        [(*row, number) for number, row in enumerate(rows)], "lang string, seed string, ord bigint"
    )


def markets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(geo,) for geo in MARKETS], "geo string")
