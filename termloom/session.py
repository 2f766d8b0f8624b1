"""Session settings the operators rely on, and a local session for tests and bench."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("termloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TERMLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the ``spark.checkpoint.dir`` that driver and executors share.

    Without that setting a run on one machine takes a temporary folder; a cluster needs the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="run-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The shuffle files behind a table go as soon as it is written.
CLEAN_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the actions inside only."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows computed once and read back from a table in the shared folder.

    For results that several reports read: each ordered report samples its input and then reads
    it again, which would evaluate the rules every time. The table survives lost executors.
    """
    path = shared_folder(rows.sparkSession, name)
    with settings(rows.sparkSession, CLEAN_SHUFFLES):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
