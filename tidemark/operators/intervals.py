"""Join of points on an axis with the intervals that hold them.

Days, months and month indexes are whole numbers on their axis.  An interval is
written out once for each bucket of ``width`` positions it touches, which turns
the range condition into an equality on the bucket with a filter behind it:
Spark hashes on the bucket and needs no nested loop, and a bucket with very many
points is split like any hot join key.  A point lies in one bucket, so it meets
an interval once however wide that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timekeys import ColumnOrName, as_col, day_of, month_from_key, month_number

#: Positions of a bucket.  Wider ones write an interval out fewer times, narrower ones let fewer intervals meet a point in vain.
WIDTH = 16


def day_position(c: ColumnOrName) -> Column:
    """Days since 1970 of a date, a timestamp or ISO text."""
    return F.unix_date(day_of(c)).cast("long")


def month_position(c: ColumnOrName) -> Column:
    """Months since year 0 of ``yyyy-MM`` text."""
    return month_number(month_from_key(c)).cast("long")


def index_position(c: ColumnOrName) -> Column:
    """The number of a month index such as ``M3`` or ``M+3``; other text has none."""
    digits = F.regexp_extract(as_col(c), r"^M\+?(\d+)$", 1)
    return F.when(digits != "", digits.cast("long"))


POSITIONS = {"day": day_position, "month": month_position, "index": index_position}


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    at: ColumnOrName,
    first: ColumnOrName,
    last: ColumnOrName,
    how: str = "left",
    width: int = WIDTH,
) -> DataFrame:
    """Each point with every interval that holds its position, both ends included; columns of both.

    ``at`` is the position of a point, ``first`` and ``last`` are those of an
    interval.  A null end is open: it reaches to the first or last point there
    is, which Spark finds while the plan runs.  An interval that ends before it
    begins holds nothing.  A point without a position is in no interval; with
    ``how="left"`` points in none are kept with nulls.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how is left or inner, not {how}")
    known = points.withColumn("_at", as_col(at))
    ends = known.agg(F.struct(F.min("_at").alias("low"), F.max("_at").alias("high"))).scalar()
    # Cut to the points there are, so that a bucket is written only where a point can be.
    cut = intervals.withColumn("_ends", ends)
    cut = cut.withColumn("_first", F.greatest(as_col(first), F.col("_ends.low"))).withColumn("_last", F.least(as_col(last), F.col("_ends.high")))
    cut = cut.filter(F.col("_first") <= F.col("_last"))
    buckets = F.sequence(F.floor(F.col("_first") / width), F.floor(F.col("_last") / width))
    written = cut.drop("_ends").withColumn("_bucket", F.explode(buckets))
    placed = known.withColumn("_at_bucket", F.floor(F.col("_at") / width))
    inside = (F.col("_at_bucket") == F.col("_bucket")) & F.col("_at").between(F.col("_first"), F.col("_last"))
    return placed.join(written, inside, how).drop("_at", "_at_bucket", "_bucket", "_first", "_last")
