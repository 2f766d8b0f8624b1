"""First and last row per key, and rows whose key is not stored yet.

A key may be held by a third of all rows. The smallest ``order`` of a key is a plain minimum, kept in a fixed-width buffer
and reduced inside every task before the shuffle; its row is then found by key and ``order`` together, which spreads the
rows of a hot key over all tasks. So there is no sort by key, no window, and no task that receives a key's rows.

The rows so found are as many as the keys, and Spark's estimate of their size may be hundreds of times too low, as behind an
exploded array; so both sides are always dealt out by a merge join, and no task ever holds all of them.

``order`` has to be unique inside a key; rows that share the smallest one all come out.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import stored as stored_once


def _matching(rows: DataFrame, picked: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
    """Rows that agree with a picked one in all of the columns; a missing value agrees with a missing one."""
    renamed = picked.select(*[F.col(name).alias(f"_of_{name}") for name in columns])
    same = [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in columns]
    return rows.join(renamed.hint("merge"), functools.reduce(Column.__and__, same), how)


def first_per_key(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The whole row with the smallest ``order`` per key."""
    least = rows.groupBy(*keys).agg(F.min(order).alias(order))
    return _matching(rows, least, [*keys, order])


def first_spelling(suggestions: DataFrame, scope: list[str], order: str = "ord") -> DataFrame:
    """First suggestion per lower-cased keyword inside one expansion (``scope`` columns)."""
    keyed = suggestions.withColumn("_key", F.lower("keyword"))
    return first_per_key(keyed, [*scope, "_key"], order).drop("_key")


def last_value(rows: DataFrame, key: str, value: str, order: str = "ord") -> DataFrame:
    """Last non-empty ``value`` per key."""
    given = rows.select(key, value, order).where(F.col(value) != "")
    latest = given.groupBy(key).agg(F.max(order).alias(order))
    return _matching(given, latest, [key, order]).select(key, value)


def new_keys(
    incoming: DataFrame, stored: DataFrame, keys: list[str], order: str = "ord"
) -> DataFrame:
    """Key and smallest ``order`` of every incoming key that is not stored.

    Only keys travel here. The stored ones are reduced to the incoming ones by a semi join first: when these are few
    (Spark checks their size before it broadcasts) the stored table is only scanned; when they are many, a stored table
    that is bucketed by the leading key needs no shuffle either.
    """
    least = incoming.groupBy(*keys).agg(F.min(order).alias(order))
    known = stored.select(*keys).join(least.select(*keys), keys, "left_semi")
    return least.join(known, keys, "left_anti")


def only_new(
    incoming: DataFrame, stored: DataFrame, keys: list[str], order: str = "ord"
) -> DataFrame:
    """First incoming row of every key that is not stored.

    The incoming rows are computed once, into a table in the shared folder, because their keys are read before they are.
    """
    landed = stored_once(incoming, "incoming")
    return _matching(landed, new_keys(landed, stored, keys, order), [*keys, order])


def marked_new(
    incoming: DataFrame, stored: DataFrame, keys: list[str], order: str = "ord", name: str = "is_new"
) -> DataFrame:
    """All incoming rows, with whether a row is the first of a key that is not stored."""
    landed = stored_once(incoming, "incoming")
    fresh = new_keys(landed, stored, keys, order)
    renamed = fresh.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, order)], F.lit(True).alias("_fresh"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, order)]
    joined = landed.join(renamed.hint("merge"), functools.reduce(Column.__and__, same), "left")
    return joined.select(*incoming.columns, F.coalesce("_fresh", F.lit(False)).alias(name))
