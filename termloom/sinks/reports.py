"""Ordered CSV reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.fixed_values import CYCLONE_SEASON, HIGH_SEASON, MONTH_LABELS

@dataclass(frozen=True)
class Report:
    """Columns of a report (name -> source column, None for a blank one) and its order."""

    columns: dict[str, str | None]
    order: tuple[str, ...]

    def of(self, rows: DataFrame, tie: str | None = "ord") -> DataFrame:
        """Report rows in order; equal ones keep their input order (``tie``).

        The tie column also lets the range partitioning split a key that very many rows share.
        """
        return rows.orderBy(*self.order, *_tie(rows, tie)).select(*self.selected())

    def selected(self) -> list[Column]:
        return [
            (F.lit("") if source is None else F.col(source)).alias(name)
            for name, source in self.columns.items()
        ]

    def write(
        self,
        rows: DataFrame,
        path: str,
        files: int | None = None,
        tie: str | None = "ord",
        rows_per_file: int = 1_000_000,
    ) -> None:
        """Replace the report at ``path`` by part files in order, of at most ``rows_per_file`` rows.

        ``files`` fixes their number instead, e.g. 1 for a single file, whatever its length.
        """
        order = [*self.order, *_tie(rows, tie)]
        ranged = rows.orderBy(*order) if files is None else (
            rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
        )
        out = ranged.select(*self.selected()).write.mode("overwrite")
        out.option("maxRecordsPerFile", rows_per_file if files is None else 0).csv(
            path, header=True, escape='"', emptyValue="", encoding="UTF-8",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )


def _tie(rows: DataFrame, tie: str | None) -> list[str]:
    if tie and tie not in rows.columns:
        raise ValueError(f"the rows have no column {tie} to order equal rows by; pass tie=None if there are none")
    return [tie] if tie else []


def _same(*names: str) -> dict[str, str | None]:
    return {name: name for name in names}


TAGGING_SHEET = Report(
    _same("keyword", "seed", "lang") | {"intent": None, "notes": None}, ("keyword",)
)
FOREIGN_LANGUAGE = Report(
    _same("detected_lang", "keyword", "seed") | {"declared_lang": "lang"},
    ("detected_lang", "keyword"),
)
CLUSTERED = Report(
    _same("cluster", "keyword", "seed", "lang", "intent", "notes"), ("cluster", "keyword")
)
CROSS_LANGUAGE = Report(
    {"resolved_lang": "lang"} | _same("keyword", "seed", "cluster", "intent"),
    ("lang", "keyword"),
)
CLASSIFIED = Report(
    _same("keyword", "seed", "lang", "intent", "matched_rule"), ("intent", "keyword")
)
NEEDS_REVIEW = Report(
    _same("keyword", "seed", "lang") | {"intent": None, "notes": None}, ("keyword",)
)
MONTHLY = Report(_same("keyword", *MONTH_LABELS), ("keyword",))
SEASONS = Report(_same("keyword", HIGH_SEASON, CYCLONE_SEASON), ("keyword",))
NO_MATCH = Report(_same("keyword", "seed", "lang", "intent", "notes"), ("ord",))
CONFLICTS = Report(
    _same("keyword", "seed", "lang", "intent", "notes", "matched_categories"), ("ord",)
)
