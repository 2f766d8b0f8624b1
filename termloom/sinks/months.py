"""Month state: partial sums per market, keyword and month, merged by appends and compacted to snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.numbers import mean_of_parts, mean_parts, round_exact
from termloom.session import CLEAN_SHUFFLES, remove_folder, settings
from termloom.sources.tables import market_label

STATE = (
    "keyword string, geo string, month int, _high bigint, _low bigint, _rest double, _n bigint, "
    "_seq bigint, last_score double, market string"
)
KEY = ["market", "geo", "keyword", "month"]
#: Appends after which the state is compacted, so that a read never merges more of them.
COMPACT_AFTER = 16


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the finished appends and snapshots. A write that was broken off has left no mark of success."""
    found: dict[str, list[int]] = {"append": [], "snapshot": []}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(root):
        for status in system.listStatus(root):
            kind, _, number = status.getPath().getName().partition("-")
            if kind in found and number.isdigit() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
    return {kind: sorted(numbers) for kind, numbers in found.items()}


def _current(folders: dict[str, list[int]]) -> list[str]:
    """The last snapshot and the appends since then."""
    upto = folders["snapshot"][-1] if folders["snapshot"] else -1
    return [f"snapshot-{upto}"] * (upto >= 0) + [f"append-{n}" for n in folders["append"] if n > upto]


def _parts(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of several folders, each with its own market folders."""
    if not names:
        return spark.createDataFrame([], STATE)
    read = [spark.read.schema(STATE).parquet(f"{path}/{name}") for name in names]
    out = read[0]
    for more in read[1:]:
        out = out.unionByName(more)
    return out


def _merged(parts: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("_high", "_low", "_rest", "_n")]
    return parts.groupBy(*KEY).agg(
        *sums, F.max_by("last_score", "_seq").alias("last_score"), F.max("_seq").alias("_seq")
    )


def _write(rows: DataFrame, path: str) -> None:
    columns = [c.split()[0] for c in STATE.split(", ")]
    with settings(rows.sparkSession, CLEAN_SHUFFLES):
        # only an unfinished write of the same number can stand there
        rows.select(*columns).write.mode("overwrite").partitionBy("market").parquet(path)


def merge_scores(
    scores: DataFrame, path: str, geo: str | None = "", order: str = "ord", compact_after: int = COMPACT_AFTER
) -> None:
    """Add scores (keyword, month, interest_score) of a market to its months; repeats add up.

    With ``geo=None`` a column ``geo`` names the markets. Each append writes one row per market, keyword and month, whatever the
    number of scores; nothing stored is read, but every ``compact_after`` appends all are merged to a snapshot. The last
    score of a month is that of the last append, and of greatest ``order`` in it; missing scores and NaN count for neither
    mean nor last. An append whose write breaks off leaves nothing and may run again. A table has one writer at a time.
    """
    spark = scores.sparkSession
    folders = _folders(spark, path)
    number = 1 + max([-1, *folders["append"], *folders["snapshot"]])
    market = F.coalesce("geo", F.lit("")) if geo is None else F.lit(geo)
    score = F.col("interest_score").cast("double")
    score = F.when(~F.isnan(score), score)
    rows = scores.select(
        "keyword", F.col("month").cast("int").alias("month"), market.alias("geo"),
        F.when(market == "", market_label("")).otherwise(market).alias("market"),
        score.alias("_score"), F.when(score.isNotNull(), F.col(order)).alias("_order"),
    )
    parts = rows.groupBy(*KEY).agg(*mean_parts(F.col("_score")), F.max_by("_score", "_order").alias("last_score"))
    # without any score a month has no last append
    seq = F.when(F.col("last_score").isNotNull(), F.lit(number).cast("long")).alias("_seq")
    _write(parts.select("*", seq), f"{path}/append-{number}")
    upto = folders["snapshot"][-1] if folders["snapshot"] else -1
    if sum(n > upto for n in folders["append"]) + 1 >= compact_after:
        compact_months(spark, path)


def compact_months(spark: SparkSession, path: str) -> None:
    """Merge the last snapshot and the appends since then to a new one.

    What that snapshot was made of stays until the next compaction, for reads that have begun; what is older goes.
    """
    folders = _folders(spark, path)
    names = _current(folders)
    if not folders["append"] or folders["snapshot"][-1:] == folders["append"][-1:]:
        return
    _write(_merged(_parts(spark, path, names)), f"{path}/snapshot-{folders['append'][-1]}")
    before = folders["snapshot"][-1] if folders["snapshot"] else -1
    old = [f"append-{n}" for n in folders["append"] if n <= before] + [f"snapshot-{n}" for n in folders["snapshot"][:-1]]
    for name in old:
        remove_folder(spark, f"{path}/{name}")


def read_months(spark: SparkSession, path: str, geo: str | None = None) -> DataFrame:
    """``keyword, geo, month, n, interest_score, last_score``: number, rounded mean and last of each month's scores.

    A market reads its folders alone ('' is the worldwide one, None means all).
    """
    parts = _parts(spark, path, _current(_folders(spark, path)))
    if geo is not None:
        parts = parts.where((F.col("market") == market_label(geo)) & (F.col("geo") == geo))
    mean: Column = mean_of_parts(F.lit(True))
    return parts.groupBy(*KEY).agg(
        F.sum("_n").alias("n"),
        round_exact(mean).alias("interest_score"),
        F.max_by("last_score", "_seq").alias("last_score"),
    ).drop("market")
