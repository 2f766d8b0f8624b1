"""The append step as a stream over landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom import schemas
from termloom.schemas import KEYWORD_KEY, STORED_KEYWORDS
from termloom.session import remove_folder, settings, shared_folder
from termloom.sinks.tables import add_rows, append_keywords, ensure_table
from termloom.sources.bucketed import has_batch, high_water
from termloom.sources.suggestions import decode_suggestions
from termloom.sources.tables import read_keywords
from termloom.streaming.spellings import ROCKSDB, SLOTS, first_spellings

#: How long files of an expansion may land after its first one.
WAIT = "1 day"


def stream_payloads(spark: SparkSession, path: str, files_per_batch: int = 1000, wait: str = WAIT) -> DataFrame:
    """Suggestions of landed JSON lines as a stream, with the landing time of their file as event time.

    A line without a request number and without a payload ends a round (``end_round``): what landed before it waits no longer.
    """
    landed = (
        spark.readStream.schema(schemas.PAYLOADS)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
        .select("*", F.col("_metadata.file_modification_time").alias("_landed"))
    )
    ends = F.col("ord").isNull() & F.col("payload").isNull()
    later = F.col("_landed") + F.expr(f"interval {wait}") + F.expr("interval 1 millisecond")
    timed = landed.withColumn("landed_at", F.when(ends, later).otherwise(F.col("_landed"))).drop("_landed")
    return decode_suggestions(timed.withWatermark("landed_at", wait))


def end_round(spark: SparkSession, path: str) -> None:
    """Land the line that ends a round of collecting; batches see no suggestion in it."""
    line = spark.range(1).select(F.lit(None).cast("string").alias("payload"))
    line.write.mode("append").option("ignoreNullFields", False).json(path)


def append_spellings(
    suggestions: DataFrame, table: str, checkpoint: str | None = None, once: bool = True, slots: int = SLOTS
) -> StreamingQuery:
    """Append what the batch would append, whatever the order in which the files of a round land.

    The stream's state holds the first spelling per expansion and what is stored; it begins with the stored table, which
    no micro-batch reads again. A micro-batch that is replayed after a failure is told by its number, which is
    committed with its rows. ``once`` stops after the files that have landed.
    """
    spark = suggestions.sparkSession
    ensure_table(spark, table, STORED_KEYWORDS, "lang")
    checkpoint = checkpoint or shared_folder(spark, "append-spellings")

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if has_batch(session, table, checkpoint, number):
            return
        staged = shared_folder(session, "decided")
        batch.write.parquet(staged)  # the state is worked through once
        rows = session.read.schema(batch.schema).parquet(staged)
        if not rows.isEmpty():
            given, buckets = high_water(session, table)
            add_rows(rows, rows, table, given, buckets, writer=checkpoint, batch=number)
        remove_folder(session, staged)

    decided = first_spellings(suggestions, read_keywords(spark, table), slots)
    writer = decided.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint)
    with settings(spark, ROCKSDB):
        return (writer.trigger(availableNow=True) if once else writer).start()


def append_stream(
    suggestions: DataFrame, table: str, checkpoint: str | None = None, once: bool = True
) -> StreamingQuery:
    """Append new rows batch by batch, as they come; here the stored table itself is the key state.

    For rows whose spelling is not in question. A batch replayed after a failure adds nothing, because its rows are
    already stored. ``once`` stops after the files that have landed.
    """
    spark = suggestions.sparkSession

    def add(batch: DataFrame, _: int) -> None:
        append_keywords(batch, table)

    writer = suggestions.writeStream.foreachBatch(add).option(
        "checkpointLocation", checkpoint or shared_folder(spark, "append-stream")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_recent(
    suggestions: DataFrame, table: str, wait: str = WAIT, checkpoint: str | None = None, once: bool = True
) -> StreamingQuery:
    """Append the rows of a stream with an event time ``landed_at``, letting one row per key through in ``wait``.

    The state forgets a key once the watermark has passed its row by ``wait``, so it is bounded by the keys of that span, however long the
    stream runs; rows older than the watermark are dropped. A key that comes again later passes again, and the comparison
    with the stored table keeps it from being stored twice.
    """
    seen = suggestions.withColumns({key: F.coalesce(key, F.lit("")) for key in KEYWORD_KEY})
    recent = seen.withWatermark("landed_at", wait).dropDuplicatesWithinWatermark(KEYWORD_KEY)
    return append_stream(recent, table, checkpoint, once)
