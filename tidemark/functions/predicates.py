"""Row filters with the null and month-text behaviour the metrics rely on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.timekeys import ColumnOrName, as_col, month_from_key


def differs(c: ColumnOrName, value) -> Column:
    """``c != value`` that keeps nulls."""
    return ~as_col(c).eqNullSafe(F.lit(value))


def month_between(c: ColumnOrName, first: str | None = None, last: str | None = None) -> Column:
    """Inclusive range on ``yyyy-MM`` text, whose text order is time order."""
    keep = F.lit(True)
    if first is not None:
        keep = keep & (as_col(c) >= F.lit(first))
    if last is not None:
        keep = keep & (as_col(c) <= F.lit(last))
    return keep


def in_months(date: ColumnOrName, first: str | None = None, last: str | None = None) -> Column:
    """The same range on a date or timestamp column.

    A range of plain values reaches the scan, which then skips files and row
    groups; a filter on the month text of a finished table can not.
    """
    keep = F.lit(True)
    if first is not None:
        keep = keep & (as_col(date) >= month_from_key(F.lit(first)))
    if last is not None:
        keep = keep & (as_col(date) < F.add_months(month_from_key(F.lit(last)), 1))
    return keep


def cohort_complete(cohort_month: ColumnOrName, observed_to: dt.date | Column, horizon: int) -> Column:
    """Has the cohort of a month (any date in it) been tracked for ``horizon`` months by ``observed_to``?"""
    following = F.add_months(F.trunc(F.lit(observed_to), "month"), 1 - horizon)
    return as_col(cohort_month) < following


def reaches(rate: ColumnOrName, threshold: float) -> Column:
    """Does a rate reach a reference line?"""
    return as_col(rate) >= F.lit(threshold)
