"""Exact-day N-day retention of new and returning users.

A user's logins of one month are kept as one integer with a bit per day.  The
shuffle then carries one small row per user and month instead of one per user
and day, and "did the user come back exactly n days later" becomes a shift and
an AND against the same user's next months.  No self-join is involved.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import reaches
from tidemark.functions.ratios import ratio_or_zero
from tidemark.functions.timekeys import day_of, month_key, month_start
from tidemark.operators.joins import one_row_per_user
from tidemark.operators.reshape import melt

OFFSETS = (1, 7, 14, 30)
USER_TYPES = {"all": "all", "new": "new", "returning": "returning"}
LAST_BIT = 30  # bit 0 is the first of the month, bit 30 the thirty-first


def user_months(logins: DataFrame, user: str = "user_id", date: str = "login_date") -> DataFrame:
    """One row per user and month; ``days`` has a bit for each day with a login."""
    known = logins.filter(F.col(user).isNotNull() & F.col(date).isNotNull())
    dated = known.select(F.col(user).alias("user_id"), day_of(date).alias("day"))
    bits = F.expr("bit_or(shiftleft(1L, dayofmonth(day) - 1))").alias("days")
    return dated.groupBy("user_id", month_start("day").alias("month")).agg(bits)


def _with_signup_bit(activity: DataFrame, users: DataFrame | None) -> DataFrame:
    """Add ``new_day``: the bit of the signup day if the user logged in on it."""
    if users is None:
        first_day = "month = min(month) OVER (PARTITION BY user_id)"
        return activity.withColumn("new_day", F.expr(f"CASE WHEN {first_day} THEN days & -days ELSE 0L END"))
    signups = one_row_per_user(users, "create_date").withColumn("create_date", day_of("create_date"))
    new_day = """CASE WHEN month = trunc(create_date, 'month')
                      THEN days & shiftleft(1L, dayofmonth(create_date) - 1) ELSE 0L END"""
    joined = activity.join(signups, "user_id", "left")
    return joined.select("user_id", "month", "days", F.expr(new_day).alias("new_day"))


def _months_ahead(n: int) -> range:
    """How many months ahead a day plus ``n`` can lie."""
    return range(n // 31, (n + LAST_BIT) // 28 + 1)


def _returned(n: int) -> str:
    """Bits of the days after which the user came back exactly ``n`` days later.

    The bits of the months where day + n can lie are moved to the positions of
    this month: ``gap_k`` is the distance in days to the month k months ahead.
    """
    moved = [
        f"""CASE WHEN gap_{k} - {n} BETWEEN 0 AND {LAST_BIT} THEN shiftleft(ahead_{k}, gap_{k} - {n})
                 WHEN gap_{k} - {n} BETWEEN -{LAST_BIT} AND -1 THEN shiftright(ahead_{k}, {n} - gap_{k})
                 ELSE 0L END"""
        for k in _months_ahead(n)
    ]
    return f"days & ({' | '.join(moved)})"


def user_day_totals(
    months: DataFrame, users: DataFrame | None = None, offsets: Sequence[int] = OFFSETS
) -> DataFrame:
    """Per login day: users, new users and how many of each came back, from :func:`user_months`.

    ``first_all`` and ``first_returning`` count each user on the first day of
    the month on which they were active at all or as a returning user, so that
    their sum over a month is the month's distinct users.
    """
    if not offsets or min(offsets) < 1:
        raise ValueError(f"offsets must be days after the login, got {offsets!r}")
    activity = _with_signup_bit(months, users)
    numbered = activity.withColumn("month_no", F.expr("year(month) * 12 + month(month)"))
    ahead = []
    for k in sorted({k for n in offsets for k in _months_ahead(n)}):
        frame = f"PARTITION BY user_id ORDER BY month_no RANGE BETWEEN {k} FOLLOWING AND {k} FOLLOWING"
        ahead.append("days AS ahead_0" if k == 0 else f"coalesce(max(days) OVER ({frame}), 0L) AS ahead_{k}")
        ahead.append(f"datediff(add_months(month, {k}), month) AS gap_{k}")
    masks = numbered.selectExpr("month", "days", "new_day", *ahead).selectExpr(
        "month",
        "days",
        "new_day",
        "days & -days AS first_all",
        "(days & ~new_day) & -(days & ~new_day) AS first_returning",
        *[f"{_returned(n)} AS d{n}" for n in offsets],
    )
    positions = ", ".join(str(bit) for bit in range(LAST_BIT + 1))
    per_day = masks.selectExpr("*", f"explode(array({positions})) AS bit").filter("getbit(days, bit) = 1")
    sums = {"new_users": "new_day", "first_all": "first_all", "first_returning": "first_returning"}
    for n in offsets:
        sums |= {f"d{n}": f"d{n}", f"d{n}_new": f"d{n} & new_day"}
    return per_day.groupBy(F.expr("date_add(month, bit)").alias("login_date")).agg(
        F.count("*").alias("dau"),
        *[F.expr(f"sum(getbit({mask}, bit))").alias(name) for name, mask in sums.items()],
    )


def _by_user_type(
    totals: DataFrame, offsets: Sequence[int], obs_end: dt.date | None, user_types: Mapping[str, str]
) -> DataFrame:
    """One row per day and user type.  ``totals`` has one row per day.

    A day counts as eligible for offset n if day + n was still observed; the
    window for the last observed day is over the few rows of ``totals``.
    """
    last_day = f"DATE '{obs_end}'" if obs_end else "max(login_date) OVER ()"
    days = totals.withColumn("last_day", F.expr(last_day)).filter("login_date <= last_day")
    # dau, distinct users of the month, and retained users of each type
    kinds = {
        "all": ("dau", "first_all", "d{n}"),
        "new": ("new_users", "new_users", "d{n}_new"),
        "returning": ("dau - new_users", "first_returning", "d{n} - d{n}_new"),
    }
    rows = []
    for kind, (dau, mau, retained) in kinds.items():
        counts = [dau, mau]
        for n in offsets:
            tracked = f"date_add(login_date, {n}) <= last_day"
            counts += [f"if({tracked}, {dau}, 0L)", f"if({tracked}, {retained.format(n=n)}, 0L)"]
        label = user_types[kind].replace("'", "\\'")
        rows += [f"'{label}'", *counts]
    names = ["user_type", "dau", "mau", *[f"d{n}_{what}" for n in offsets for what in ("eligible", "retained")]]
    stacked = f"stack({len(kinds)}, {', '.join(rows)}) AS ({', '.join(names)})"
    return days.selectExpr("login_date", stacked).filter("dau > 0")


def _rates(offsets: Sequence[int]) -> list[Column]:
    return [ratio_or_zero(f"d{n}_retained", f"d{n}_eligible").alias(f"d{n}_ret") for n in offsets]


def daily_rates(
    totals: DataFrame,
    offsets: Sequence[int] = OFFSETS,
    obs_end: dt.date | None = None,
    user_types: Mapping[str, str] = USER_TYPES,
) -> DataFrame:
    """Retention per day and user type from :func:`user_day_totals`."""
    days = _by_user_type(totals, offsets, obs_end, user_types)
    eligible = [f"d{n}_eligible" for n in offsets]
    return days.select("login_date", "user_type", "dau", *eligible, *_rates(offsets))


def monthly_rates(
    totals: DataFrame,
    offsets: Sequence[int] = OFFSETS,
    obs_end: dt.date | None = None,
    user_types: Mapping[str, str] = USER_TYPES,
) -> DataFrame:
    """Retention per month and user type from :func:`user_day_totals`."""
    days = _by_user_type(totals, offsets, obs_end, user_types)
    counts = [f"d{n}_{what}" for what in ("eligible", "retained") for n in offsets]
    months = days.groupBy(month_key("login_date").alias("login_year_month"), "user_type").agg(
        F.sum("mau").alias("mau"), F.sum("dau").alias("mau_not_unique"), *[F.sum(c).alias(c) for c in counts]
    )
    eligible = [f"d{n}_eligible" for n in offsets]
    return months.select("login_year_month", "user_type", "mau", "mau_not_unique", *eligible, *_rates(offsets))


def _observed(logins: DataFrame, obs_end: dt.date | None) -> DataFrame:
    return logins if obs_end is None else logins.filter(day_of("login_date") <= F.lit(obs_end))


def nday_retention_daily(
    logins: DataFrame,
    users: DataFrame | None = None,
    offsets: Sequence[int] = OFFSETS,
    obs_end: dt.date | None = None,
    user_types: Mapping[str, str] = USER_TYPES,
) -> DataFrame:
    """Per day and user type: ``dau`` and the share that came back after exactly n days.

    A login on the signup day is ``new``, any other ``returning``.  Without
    ``users`` the first login is the signup.  A rate is 0 while day + n is not
    observed yet; ``dN_eligible`` is 0 there too.
    """
    totals = user_day_totals(user_months(_observed(logins, obs_end)), users, offsets)
    return daily_rates(totals, offsets, obs_end, user_types)


def nday_retention_monthly(
    logins: DataFrame,
    users: DataFrame | None = None,
    offsets: Sequence[int] = OFFSETS,
    obs_end: dt.date | None = None,
    user_types: Mapping[str, str] = USER_TYPES,
) -> DataFrame:
    """Per month and user type: distinct users, user-days, and pooled retention.

    A rate is the retained over the eligible user-days of the month.
    """
    totals = user_day_totals(user_months(_observed(logins, obs_end)), users, offsets)
    return monthly_rates(totals, offsets, obs_end, user_types)


def retention_long(
    retention: DataFrame,
    threshold: float = 0.7,
    user_type: str | None = None,
    offsets: Sequence[int] = OFFSETS,
) -> DataFrame:
    """One row per period, user type and offset, flagged where the rate reaches ``threshold``."""
    if user_type is not None:
        retention = retention.filter(F.col("user_type") == user_type)
    ids = [retention.columns[0], "user_type"]
    long = melt(retention, ids, [f"d{n}_ret" for n in offsets])
    return long.withColumn("reaches_threshold", reaches("value", threshold))
