"""Exact means and rounding, independent of row order and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = float(2**27 + 1)
_LIMIT = float(2**46)  # beyond it doubles are coarser than two decimals
_BITS = 24
_PARTS = ("_high", "_low", "_rest", "_n")


def round_exact(value: Column, places: int = 2) -> Column:
    """Round the exact binary value half to even, like ``round`` in Python.

    ``F.round`` and ``F.bround`` round the shortest decimal form (2.675 -> 2.68), although
    the double lies below the tie. Here the product ``value * 10**places`` is split into a
    rounded part and its exact error, which decides the near-ties.
    """
    if not 0 <= places <= 2:
        raise ValueError("places must be 0, 1 or 2")
    scale = float(10**places)
    size = F.abs(value)
    product = size * scale
    split = size * _SPLITTER
    high = split - (split - size)
    error = (high * scale - product) + (size - high) * scale
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | (
        (rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1)))
    )
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(size < _LIMIT, F.signum(value) * rounded).otherwise(value)


def _grid(value: Column, places: int) -> tuple[Column, Column, Column]:
    scale = float(10**places)
    value = F.when(~F.isnan(value), value)
    # what is too large for the grid, infinity too, is summed as a double
    grid = F.when(F.abs(value) < _LIMIT, F.rint(value * scale)).otherwise(F.when(value.isNotNull(), 0.0))
    return grid.cast("long"), value - grid / scale, value


def _sums(units: Column, rest: Column) -> list[Column]:
    """The high and low bits of the units are summed apart, so that no number of rows overflows a sum."""
    return [F.sum(F.shiftright(units, _BITS)), F.sum(units.bitwiseAND(F.lit((1 << _BITS) - 1))), F.sum(rest)]


def _mean(high: Column, low: Column, rest: Column, n: Column, places: int) -> Column:
    units = high.cast("double") * float(1 << _BITS) + low.cast("double")
    return F.try_divide(units / float(10**places) + rest, n.cast("double"))


def exact_mean(value: Column, places: int = 2) -> Column:
    """Mean whose sum does not depend on row order for values of at most ``places`` decimals.

    Such values are summed as integers. What is off that grid, or beyond 2**46, is summed as a double
    beside it, so any input is summed whole. Missing and NaN values are skipped. All
    buffers are primitive, so Spark aggregates partially by hash before the shuffle.
    """
    units, rest, value = _grid(value, places)
    return _mean(*_sums(units, rest), F.count(value), places)


def mean_parts(value: Column, places: int = 2) -> list[Column]:
    """The sums behind ``exact_mean`` as columns, to aggregate on and finish later."""
    units, rest, value = _grid(value, places)
    columns = [*_sums(units, rest), F.count(value)]
    return [column.alias(name) for column, name in zip(columns, _PARTS, strict=True)]


def mean_of_parts(where: Column, places: int = 2) -> Column:
    """``exact_mean`` over rows of ``mean_parts`` that fulfil a condition."""
    return _mean(*[F.sum(F.when(where, F.col(name))) for name in _PARTS], places)


def rounded_mean(value: Column, places: int = 2) -> Column:
    return round_exact(exact_mean(value, places), places)
