"""Dates, month keys and month arithmetic.

Facts are grouped on the first day of the month as a DATE, which is four bytes
in a shuffle and costs no text formatting per row; the ``yyyy-MM`` text appears
only on the finished metric tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of(c: ColumnOrName) -> Column:
    """Calendar day of a date, timestamp or ISO text; malformed text raises."""
    return F.to_date(as_col(c))


def timestamp_of(c: ColumnOrName) -> Column:
    """Zone-free timestamp of ISO text; malformed text raises."""
    return as_col(c).cast("timestamp_ntz")


def month_start(c: ColumnOrName) -> Column:
    """First day of the month that holds a date or timestamp."""
    return F.trunc(day_of(c), "month")


def month_key(c: ColumnOrName) -> Column:
    """``yyyy-MM`` text of a date or timestamp."""
    return F.date_format(as_col(c), "yyyy-MM")


def year_key(c: ColumnOrName) -> Column:
    """``yyyy`` text of a date or timestamp."""
    return F.date_format(as_col(c), "yyyy")


def month_from_key(c: ColumnOrName) -> Column:
    """First day of the month named by ``yyyy-MM`` text."""
    return F.to_date(as_col(c), "yyyy-MM")


def month_number(c: ColumnOrName) -> Column:
    """Months since year 0, so that consecutive months differ by one."""
    c = as_col(c)
    return F.year(c) * 12 + F.month(c)


def months_elapsed(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole calendar months from the month of ``start`` to the month of ``end``."""
    return month_number(end) - month_number(start)


def add_days(c: ColumnOrName, n: int) -> Column:
    return F.date_add(as_col(c), n)


def end_of_last_full_month(last_day: ColumnOrName) -> Column:
    """The last day of the last month that ended by ``last_day``: that day itself if it ends its month."""
    day = day_of(last_day)
    return F.when(F.last_day(day) == day, day).otherwise(F.date_sub(F.trunc(day, "month"), 1))
