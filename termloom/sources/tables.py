"""Scans of the stored Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import schemas
from termloom.fixed_values import TOP_KEYWORDS, WORLDWIDE_LABEL


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_keywords(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """Stored keywords; a language prunes to its partition folder, '' or None reads all."""
    stored = _table(spark, path, schemas.KEYWORDS)
    if lang:
        stored = stored.where(F.col("lang") == lang)
    else:
        stored = stored.where(~F.col("lang").eqNullSafe(schemas.HIGH_WATER))
    # an empty partition value is stored as null
    return stored.withColumn("lang", F.coalesce("lang", F.lit("")))


def read_scores_table(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, schemas.SCORES)


def read_scores(spark: SparkSession, path: str, geo: str = "") -> DataFrame:
    """Stored month scores of one market; '' is the worldwide market, not "all"."""
    return (
        read_scores_table(spark, path)
        .where((F.col("market") == market_label(geo)) & (F.col("geo") == geo))
        .drop("market")
    )


def market_label(geo: str) -> str:
    return geo or WORLDWIDE_LABEL


def first_keywords(keywords: DataFrame, n: int = TOP_KEYWORDS, order: str = "id") -> DataFrame:
    """First keywords in scan order (the reports' "top" option)."""
    return keywords.orderBy(order).limit(n)
