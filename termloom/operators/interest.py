"""Interest series: wide to long, and means by calendar month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.numbers import rounded_mean


def unpivot_interest(
    wide: DataFrame, date: str = "date", partial: str = "isPartial", ids: list[str] | None = None
) -> DataFrame:
    """One row per date and keyword; the partial flag is dropped, partial rows stay."""
    ids = [date, *(ids or [])]
    values = [name for name in wide.columns if name not in (*ids, partial)]
    return (
        wide.select(*ids, *[F.col(f"`{name}`").cast("double").alias(name) for name in values])
        .unpivot(ids, [F.col(f"`{name}`") for name in values], "keyword", "value")
    )


def monthly_average(
    series: DataFrame,
    keys: list[str],
    date: str = "date",
    value: str = "value",
    batch: str | None = None,
) -> DataFrame:
    """Mean per key and calendar month over all years, rounded to 2; missing values are skipped.

    With a ``batch`` column the last batch that holds a key replaces the earlier ones whole.
    """
    by_batch = [batch] if batch else []
    means = (
        series.groupBy(*keys, *by_batch, F.month(date).alias("month"))
        .agg(rounded_mean(F.col(value)).alias("interest_score"))
    )
    return _last_batch(means, keys, batch) if batch else means


def _last_batch(means: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """Keep the months of a key's last batch.

    Per key this takes the last batch of all and of each month, in one aggregation that starts
    before the shuffle, and then the months in which the two agree.
    """
    columns, months = [F.max(batch).alias("_last")], []
    for month in range(1, 13):
        own_batch = F.when(F.col("month") == month, F.col(batch))
        own_score = F.when(F.col("month") == month, F.col("interest_score"))
        columns += [
            F.max(own_batch).alias(f"_batch{month}"),
            F.max_by(own_score, own_batch).alias(f"_score{month}"),
        ]
        months.append(
            F.struct(
                F.lit(month).alias("month"),
                F.col(f"_score{month}").alias("interest_score"),
                F.col(f"_batch{month}").alias("_batch"),
            )
        )
    return (
        means.groupBy(*keys).agg(*columns)
        .select(*keys, "_last", F.inline(F.array(*months)))
        .where(F.col("_batch") == F.col("_last"))
        .drop("_batch", "_last")
    )
