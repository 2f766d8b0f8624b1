"""Text helpers: every function maps Columns to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.fixed_values import BLANKS

BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"  # the same characters as BLANKS


def strip(text: Column) -> Column:
    """Remove leading and trailing blanks, Unicode ones included (``trim`` knows only the space)."""
    return F.btrim(text, F.lit(BLANKS))


def code(text: Column) -> Column:
    """A missing, padded or upper-cased code value in its plain form ('' when missing)."""
    return F.coalesce(F.lower(strip(text)), F.lit(""))


def words(text: Column) -> Column:
    """Lower-cased words between blanks, as an array without empty items."""
    return F.array_remove(F.split(F.lower(text), BLANK_RUN), "")


def ignoring_case(text: Column) -> Column:
    """Lower-case the way case-insensitive matching sees text.

    Plain lower-casing leaves three letters apart that case-insensitive matching
    treats as their ASCII partners: dotted capital I, dotless i and long s.
    """
    return F.lower(F.translate(text, "İıſ", "iis"))
