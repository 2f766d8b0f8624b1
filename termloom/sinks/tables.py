"""Appends to the stored Parquet tables (one writer per table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.keyed import new_keys
from termloom.schemas import HIGH_WATER, KEYWORD_KEY, SCORES, STORED_KEYWORDS
from termloom.session import CLEAN_SHUFFLES, remove_folder, settings, shared_folder
from termloom.sources.bucketed import BY_SLOT, bucketed, high_water, register, slot_of
from termloom.sources.tables import market_label, read_scores_table


def ensure_table(spark: SparkSession, path: str, schema: str, partition: str) -> None:
    """Create an empty table where there is none; an existing one is left alone."""
    empty = spark.createDataFrame([], schema)
    empty.write.mode("ignore").partitionBy(partition).parquet(path)


def append_keywords(
    incoming: DataFrame, path: str, at: Column | None = None, buckets: int | None = None
) -> int:
    """Append suggestions whose (keyword, lang, source) is not stored; returns their number.

    The comparison is case-sensitive and the first copy in ``ord`` wins. Ids are consecutive, follow the stored
    ones and keep the order of arrival. Appending the same rows again adds nothing, so a job that lost its
    executors, or a replayed stream batch, may simply be run again. ``ord`` is unique and never missing.

    The table is bucketed by a hash of the key (``slot``), so its side of the comparison is neither shuffled nor read
    beyond the buckets that the incoming keys fall into. A table keeps the number of buckets it was begun with: ``buckets``, or
    the session's number of shuffle partitions, which is sized for the cluster and its data.
    """
    spark = incoming.sparkSession
    # a missing key part would never equal a stored one
    incoming = incoming.withColumns({key: F.coalesce(key, F.lit("")) for key in KEYWORD_KEY})
    ensure_table(spark, path, STORED_KEYWORDS, "lang")
    given, buckets = high_water(spark, path, buckets)
    staged = shared_folder(spark, "incoming")
    rows = incoming.select("keyword", "lang", "source", "seed", "ord", slot_of(buckets).alias("slot"))
    with settings(spark, CLEAN_SHUFFLES):
        rows.write.parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    touched = [row["slot"] for row in rows.select("slot").distinct().collect()]  # at most SLOTS_PER_BUCKET a bucket
    known = bucketed(spark, path, buckets).where(~F.col("lang").eqNullSafe(HIGH_WATER))
    known = known.withColumn("lang", F.coalesce("lang", F.lit(""))).where(F.col("slot").isin(touched))
    fresh = new_keys(rows, known, ["slot", *KEYWORD_KEY]).select("ord")
    inserted = add_rows(rows, fresh, path, given, buckets, at)
    remove_folder(spark, staged)
    return inserted


def add_rows(
    rows: DataFrame,
    new: DataFrame,
    path: str,
    given: int,
    buckets: int,
    at: Column | None = None,
    writer: str = "",
    batch: int | None = None,
) -> int:
    """Append the rows whose ``ord`` stands in ``new``; returns their number.

    The places alone are sorted, in ranges of like size whose counts give each range its first id. The row
    that tells how many ids were given is part of the write of the rows, so both are committed or neither. It also names
    the ``writer`` (a stream) and its ``batch``.
    """
    spark = rows.sparkSession
    staged = shared_folder(spark, "new")
    ordered = new.select("ord").repartitionByRange("ord").sortWithinPartitions("ord")
    # the number of the range above, the place inside it below
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id())
    with settings(spark, BY_SLOT | CLEAN_SHUFFLES):
        ordered.write.parquet(staged)
    places = spark.read.schema(ordered.schema).parquet(staged).select(
        "ord", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")
    )
    starts, upto = [], given
    for row in places.groupBy("_range").count().orderBy("_range").collect():  # one row a range
        starts.append((row["_range"], upto))
        upto += row["count"]
    if upto > given:
        first = spark.createDataFrame(starts, "_range long, _start long")
        when = F.current_timestamp() if at is None else at
        added = rows.join(places.join(first, "_range"), "ord").select(
            (F.col("_start") + F.col("_place")).alias("id"), "keyword", "source", "seed", when.alias("collected_at"),
            slot_of(buckets).alias("slot"), "lang",
        )
        mark = spark.range(1).select(
            F.lit(upto).cast("long").alias("id"), F.lit(None).cast("string").alias("keyword"), F.lit(writer).alias("source"),
            F.lit(batch).cast("string").alias("seed"), F.current_timestamp().alias("collected_at"),
            F.lit(buckets).alias("slot"), F.lit(HIGH_WATER).alias("lang"),
        )
        table = register(spark, path, buckets)
        with settings(spark, CLEAN_SHUFFLES):
            (
                added.unionByName(mark).repartition(buckets, "slot")
                .write.mode("append").format("parquet").partitionBy("lang").bucketBy(buckets, "slot").option("path", path)
                .saveAsTable(table)
            )
    remove_folder(spark, staged)
    return upto - given


def append_scores(
    scores: DataFrame, path: str, geo: str | None = "", at: Column | None = None
) -> None:
    """Append month scores (keyword, month, interest_score) of a market; repeats add up.

    With ``geo=None`` the scores name their markets in a column ``geo``, and all are written at once.

    ``ord`` counts the appends, so that the last score of a month can be told.
    """
    ensure_table(scores.sparkSession, path, SCORES, "market")
    stored = read_scores_table(scores.sparkSession, path)
    market = F.coalesce("geo", F.lit("")) if geo is None else F.lit(geo)
    scores.select(
        "keyword",
        market.alias("geo"),
        F.col("month").cast("int").alias("month"),
        F.col("interest_score").cast("double").alias("interest_score"),
        stored.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).scalar().alias("ord"),
        (F.current_timestamp() if at is None else at).alias("collected_at"),
        F.when(market == "", market_label("")).otherwise(market).alias("market"),
    ).write.mode("append").partitionBy("market").parquet(path)
