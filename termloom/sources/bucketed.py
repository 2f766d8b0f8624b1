"""The stored keywords as a table bucketed by a hash of their key.

Spark knows of buckets from its catalog only, so the folder is registered there as an external table under a name
made of its path; the folder itself is all there is to keep.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.schemas import HIGH_WATER, KEYWORD_KEY, STORED_KEYWORDS

#: Slots are the values rows are bucketed by; several a bucket even out the buckets.
SLOTS_PER_BUCKET = 16
#: Joins by slot and key may use the partitioning by slot alone.
BY_SLOT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def slot_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYWORD_KEY), F.lit(buckets * SLOTS_PER_BUCKET)).cast("int")


def register(spark: SparkSession, path: str, buckets: int) -> str:
    """Name of the external table over the folder, as the folder is now."""
    name = f"termloom_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"drop table if exists {name}")  # the files of an external table stay
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"create table {name} ({STORED_KEYWORDS}) using parquet partitioned by (lang) "
        f"clustered by (slot) into {buckets} buckets location '{location}'"
    )
    spark.sql(f"alter table {name} recover partitions")
    return name


def bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The stored rows by bucket; a filter on ``slot`` reads only the buckets it names."""
    return spark.table(register(spark, path, buckets))


def _marks(spark: SparkSession, path: str) -> DataFrame:
    """The rows in which appends tell how many ids were given; they have a partition of their own."""
    return spark.read.schema(STORED_KEYWORDS).parquet(path).where(F.col("lang") == HIGH_WATER)


def high_water(spark: SparkSession, path: str, buckets: int | None = None) -> tuple[int, int]:
    """Number of ids given so far, and of the table's buckets; a new table gets as many as the session has shuffle partitions."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = _marks(spark, path).agg(F.max("id").alias("given"), F.max("slot").alias("buckets")).first()
    return row["given"] or 0, row["buckets"] or buckets


def has_batch(spark: SparkSession, path: str, writer: str, batch: int) -> bool:
    """Whether a stream's batch was committed before."""
    mine = (F.col("source") == writer) & (F.col("seed") == str(batch))
    return not _marks(spark, path).where(mine).isEmpty()
