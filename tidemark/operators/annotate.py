"""Business periods on a time axis."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.intervals import POSITIONS, interval_join

#: The columns of a period's ends, by the axis it lies on.
ENDS = {"day": ("first_day", "last_day"), "month": ("first_month", "last_month"), "index": ("first_index", "last_index")}

End = dt.date | str | None


def period_table(spark: SparkSession, periods: Sequence[tuple[End, End, str]], axis: str = "day") -> DataFrame:
    """Periods given by hand: first and last day, month (``yyyy-MM``) or index (``M+n``), and text; a None end is open."""
    kind = "date" if axis == "day" else "string"
    fields = (*zip(ENDS[axis], (kind, kind)), ("note", "string"))
    rows = [F.struct(*(F.lit(v).cast(t).alias(c) for v, (c, t) in zip(period, fields))) for period in periods]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def annotate_periods(series: DataFrame, periods: DataFrame, at: str | Column, axis: str = "day") -> DataFrame:
    """Attach the ``note`` of every period whose closed range holds ``at``; null outside all.

    Periods may overlap, which gives a row for each, and be open at an end.
    ``periods`` has the columns of :func:`period_table` for the axis.
    """
    position, (first, last) = POSITIONS[axis], ENDS[axis]
    return interval_join(series, periods, position(at), position(first), position(last)).drop(first, last)
