"""Reading the given tables and keeping intermediate ones where every executor sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.session import shared_folder


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Workspace:
    """Tables below the shared folder in ``spark.checkpoint.dir``.

    A written table cuts the lineage and survives lost executors. ``drop`` removes a table as soon
    as no later step reads it; what the returned DataFrame itself reads has to stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = shared_folder(spark, name)

    def save(self, rows: DataFrame, name: str) -> DataFrame:
        # the table takes the place of the shuffle files behind it, which Spark removes as soon as it is written
        before = self.spark.conf.get(CLEAN_SHUFFLES, None)
        self.spark.conf.set(CLEAN_SHUFFLES, "true")
        try:
            rows.write.parquet(f"{self.root}/{name}")
        finally:
            if before is None:
                self.spark.conf.unset(CLEAN_SHUFFLES)
            else:
                self.spark.conf.set(CLEAN_SHUFFLES, before)
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
