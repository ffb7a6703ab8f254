"""Ratios that are null on a zero base and rounded half away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.timekeys import ColumnOrName, as_col


def ratio(numerator: ColumnOrName, denominator: ColumnOrName, digits: int = 4) -> Column:
    """``numerator / denominator`` rounded half-up; null where the base is 0."""
    top, base = as_col(numerator).cast("double"), as_col(denominator).cast("double")
    return F.round(F.try_divide(top, base), digits)


def money_ratio(numerator: ColumnOrName, denominator: ColumnOrName, digits: int) -> Column:
    """:func:`ratio` of amounts with up to four decimals.

    Both sides are scaled to whole numbers first: 0.1 has no exact double, and
    the error of a quotient of such values can move it across a rounding tie.
    """
    return ratio(as_col(numerator) * 10_000, as_col(denominator) * 10_000, digits)


def growth(current: ColumnOrName, previous: ColumnOrName, digits: int = 4) -> Column:
    """Relative change from ``previous`` to ``current``."""
    return ratio(as_col(current) - as_col(previous), previous, digits)


def ratio_or_zero(numerator: ColumnOrName, denominator: ColumnOrName, digits: int = 3) -> Column:
    """Like :func:`ratio`, but 0 where nothing could be measured."""
    return F.coalesce(ratio(numerator, denominator, digits), F.lit(0.0))


def total(amount: ColumnOrName) -> Column:
    """Sum that is 0, not null, for a group with only null amounts."""
    return F.coalesce(F.sum(as_col(amount)), F.lit(0))
