"""Queries to ask: every seed bare and followed by each letter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.fixed_values import ALPHABET


def query_frontier(seeds: DataFrame, letters: str = ALPHABET, order: str = "ord") -> DataFrame:
    """One row per query, from seeds (lang, seed, ord).

    Letters are exploded from a constant inside each row, so nothing is joined or shuffled.
    ``root_seed`` is the phrase, ``seed`` the query itself, ``ord`` the number of the request.
    """
    suffixes = F.array(F.lit(""), *[F.lit(" " + letter) for letter in letters])
    return seeds.select(
        "lang", F.col("seed").alias("root_seed"), F.col(order).alias("_at"), F.posexplode(suffixes)
    ).select(
        "lang",
        "root_seed",
        F.concat("root_seed", "col").alias("seed"),
        (F.col("_at") * (len(letters) + 1) + F.col("pos")).cast("long").alias("ord"),
    )
