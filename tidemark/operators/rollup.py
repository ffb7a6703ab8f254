"""Distinct users that roll up: marts of bitmaps or of sketches by day.

A distinct count can not be added up over days.  A bitmap of the users can: the
months, years and all of time are unions of the days, and come from one small
table instead of the logins.  A user id is a bit of a bucket of 32,768 ids, so
counts are exact for any whole-number id, and a day costs 4 KB for each bucket
that was active.

Sketches are the opt-in for ids of any type or for very many days: a few KB a
day whatever the number of users, with a known error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timekeys import ColumnOrName, as_col, day_of, month_key, month_start

#: Registers of a sketch, as a power of two: a relative standard error of 1.04 / 2 ** (LG_K / 2), 1.6 %.
LG_K = 12


def user_days(logins: DataFrame, user: str = "user_id", date: str = "login_date") -> DataFrame:
    """Distinct (user_id, day): however often a user logs in, a day of theirs is one row from here on."""
    known = logins.filter(F.col(user).isNotNull() & F.col(date).isNotNull())
    return known.select(F.col(user).alias("user_id"), day_of(date).alias("day")).distinct()


def day_bitmaps(days: DataFrame, *keys: str) -> DataFrame:
    """(day, keys, bucket, users): the users of each day as bitmaps, from :func:`user_days`, split by columns added to it.

    A key belongs to the user (the signup year, a region), so that a user is in
    one bitmap of a day.  The user-days are dealt out by what a bitmap is grouped
    by before any bitmap exists: each is made once, in one task, from at most
    32,768 users, and none is shuffled.
    """
    bits = days.select(
        "day", *keys, F.bitmap_bucket_number("user_id").alias("bucket"), F.bitmap_bit_position("user_id").alias("bit")
    )
    group = ["day", *keys, "bucket"]
    return bits.repartition(*group).groupBy(*group).agg(F.bitmap_construct_agg("bit").alias("users"))


def users_of(bitmaps: DataFrame, *by: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """(by, keys, user_cnt): distinct users of the groups ``by`` of days, exact, from :func:`day_bitmaps`.

    Without ``by`` that is the users of all days.
    """
    names = [*by, *keys, "bucket"]
    merged = bitmaps.groupBy(*names).agg(F.bitmap_or_agg("users").alias("users"))
    own = [c for c in merged.columns if c not in ("bucket", "users")]
    return merged.groupBy(*own).agg(F.sum(F.bitmap_count("users")).alias("user_cnt"))


def dau_of(bitmaps: DataFrame) -> DataFrame:
    """:func:`tidemark.operators.activity.dau` from the mart."""
    return bitmaps.groupBy(F.col("day").alias("login_date")).agg(F.sum(F.bitmap_count("users")).alias("dau"))


def mau_of(bitmaps: DataFrame) -> DataFrame:
    """:func:`tidemark.operators.activity.mau` from the mart."""
    counts = users_of(bitmaps, month_start("day").alias("month"))
    return counts.select(month_key("month").alias("login_year_month"), F.col("user_cnt").alias("login_user_cnt"))


def au_by_key(bitmaps: DataFrame, key: str) -> DataFrame:
    """Distinct users per month and value of a key of the mart, such as the signup year."""
    counts = users_of(bitmaps, month_start("day").alias("month"), keys=(key,))
    return counts.select(month_key("month").alias("login_year_month"), key, "user_cnt")


def day_sketches(logins: DataFrame, user: str = "user_id", date: str = "login_date", lg_k: int = LG_K) -> DataFrame:
    """(day, sketch): a mergeable sketch of the users of each day, straight from the logins; only sketches are shuffled."""
    known = logins.filter(F.col(user).isNotNull() & F.col(date).isNotNull())
    return known.groupBy(day_of(date).alias("day")).agg(F.hll_sketch_agg(user, lg_k).alias("sketch"))


def estimated_users(sketches: DataFrame, *by: Column) -> DataFrame:
    """(by, user_cnt): about how many distinct users the groups ``by`` of days have, from :func:`day_sketches`."""
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))  # null if there is no day at all
    return merged.select(*[c for c in merged.columns if c != "sketch"], F.hll_sketch_estimate("sketch").alias("user_cnt"))


def standard_error(lg_k: int = LG_K) -> float:
    """The relative standard error of an estimate."""
    return 1.04 / 2 ** (lg_k / 2)


def within_error(estimate: ColumnOrName, exact: ColumnOrName, lg_k: int = LG_K, errors: float = 3.0) -> Column:
    """Does an estimate lie within so many standard errors of the exact count, or next to it?"""
    off = F.abs(as_col(estimate) - as_col(exact))
    return off <= F.greatest(F.lit(1.0), errors * standard_error(lg_k) * as_col(exact))
