"""Landed answers of a suggestion service, decoded to one row per suggestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import schemas
from termloom.fixed_values import SUGGESTION_SOURCE
from termloom.functions.text import strip

#: More items than an answer can hold, because arrays are numbered by 32-bit integers.
ANSWER_ITEMS = 1 << 31


def arrival(request: Column, place: Column) -> Column:
    """Unique place of an item in the order of requests and of items inside an answer, as one comparable number."""
    return (request.cast("decimal(20,0)") * F.lit(ANSWER_ITEMS).cast("decimal(10,0)") + place).cast("decimal(38,0)")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines: lang, root_seed, seed (the query), ord (its number), payload."""
    return spark.read.schema(schemas.PAYLOADS).json(path)


def decode_suggestions(payloads: DataFrame, source: str = SUGGESTION_SOURCE) -> DataFrame:
    """Suggestions of payloads ``[query, [suggestion, ...]]``.

    Only string items count (a number stays out instead of becoming text), blanks around
    them are stripped and blank items dropped. A payload that does not parse, or has no list
    at its second place, gives no row. All other columns of the payload row are kept; its
    number becomes ``request``, the item's place in the answer ``place``, and ``ord`` orders items by both.
    """
    answer = F.try_variant_get(F.try_parse_json("payload"), "$[1]", "array<variant>")
    texts = F.filter(answer, lambda item: F.schema_of_variant(item) == "STRING")
    kept = [name for name in payloads.columns if name not in ("payload", "ord")]
    return (
        payloads.select(*kept, F.col("ord").alias("_request"), F.posexplode(texts))
        .select(
            strip(F.try_variant_get("col", "$", "string")).alias("keyword"),
            F.lit(source).alias("source"),
            *kept,
            F.col("_request").alias("request"),
            F.col("pos").alias("place"),
            arrival(F.col("_request"), F.col("pos")).alias("ord"),
        )
        .where(F.col("keyword") != "")
    )
