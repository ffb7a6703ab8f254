"""Active and new users per day and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import joined_key
from tidemark.functions.predicates import month_between
from tidemark.functions.timekeys import day_of, month_key, month_start, year_key
from tidemark.operators.joins import one_row_per_user, with_region


def monthly_activity(logins: DataFrame, user: str = "user_id", date: str = "login_date") -> DataFrame:
    """Distinct (user, month) pairs.

    This is the table the cohort and region counts start from: however often a
    user logs in, one row per month leaves the first task.
    """
    known = logins.filter(F.col(user).isNotNull() & F.col(date).isNotNull())
    return known.select(F.col(user).alias("user_id"), month_start(date).alias("login_month")).distinct()


def _users(user: str, approximate: float | None) -> Column:
    """Distinct users, or about that many with the relative standard error ``approximate``."""
    return F.count_distinct(user) if approximate is None else F.approx_count_distinct(user, approximate)


def mau(
    logins: DataFrame, user: str = "user_id", date: str = "login_date", approximate: float | None = None
) -> DataFrame:
    """Distinct active users per month; ``approximate`` names a relative error to allow instead of exact counts."""
    dated = logins.filter(F.col(date).isNotNull())
    counts = dated.groupBy(month_start(date).alias("month")).agg(_users(user, approximate).alias("login_user_cnt"))
    return counts.select(month_key("month").alias("login_year_month"), "login_user_cnt")


def dau(
    logins: DataFrame, user: str = "user_id", date: str = "login_date", approximate: float | None = None
) -> DataFrame:
    """Distinct active users per day; ``approximate`` as for :func:`mau`."""
    dated = logins.filter(F.col(date).isNotNull())
    return dated.groupBy(day_of(date).alias("login_date")).agg(_users(user, approximate).alias("dau"))


def nru(users: DataFrame, user: str = "user_id", date: str = "create_date") -> DataFrame:
    """Distinct signups per month."""
    dated = users.filter(F.col(date).isNotNull())
    counts = dated.groupBy(month_start(date).alias("month")).agg(F.count_distinct(user).alias("user_cnt"))
    return counts.select(month_key("month").alias("create_year_month"), "user_cnt")


def mau_nru_series(mau: DataFrame, nru: DataFrame, start: str | None = None) -> DataFrame:
    """Monthly actives beside monthly signups, the last month of activity flagged.

    Both inputs have one row per month, so the unpartitioned window sees a few
    hundred rows however large the facts are.
    """
    last_month = F.max("login_year_month").over(Window.partitionBy())
    active = mau.withColumn("is_latest", F.col("login_year_month") == last_month)
    months = F.coalesce("login_year_month", "create_year_month")
    both = active.join(nru, F.col("login_year_month") == F.col("create_year_month"), "full")
    series = both.select(
        months.alias("year_month"),
        F.col("login_user_cnt").alias("mau"),
        F.col("user_cnt").alias("nru"),
        F.coalesce("is_latest", F.lit(False)).alias("is_latest"),
    )
    return series.filter(month_between("year_month", start))


def au_by_signup(logins: DataFrame, users: DataFrame, grain: str = "month") -> DataFrame:
    """Distinct active users per month, split by signup year or month."""
    key, column = {"year": (year_key, "create_year"), "month": (month_key, "create_year_month")}[grain]
    period = F.trunc("create_date", grain).alias("signup_period")
    signups = one_row_per_user(users, "create_date").select("user_id", period)
    counts = monthly_activity(logins).join(signups, "user_id").groupBy("login_month", "signup_period").count()
    return counts.filter(F.col("signup_period").isNotNull()).select(
        month_key("login_month").alias("login_year_month"),
        key("signup_period").alias(column),
        F.col("count").alias("user_cnt"),
    )


def user_regions(users: DataFrame, *parts: str, user: str = "user_id") -> DataFrame:
    """User table with one ``district-quarter`` region key."""
    return users.select(F.col(user).alias("user_id"), joined_key(*parts).alias("region"))


def mau_by_region(logins: DataFrame, user_region: DataFrame) -> DataFrame:
    """Distinct active users per region and month; users without a region count under ``unknown``."""
    counts = with_region(monthly_activity(logins), user_region).groupBy("region", "login_month").count()
    return counts.select("region", month_key("login_month").alias("login_year_month"), F.col("count").alias("user_cnt"))


def nru_by_region(users: DataFrame, user_region: DataFrame) -> DataFrame:
    """Distinct signups per region and month; users without a region count under ``unknown``."""
    signups = one_row_per_user(users, "create_date").withColumn("month", month_start("create_date"))
    counts = with_region(signups.filter(F.col("month").isNotNull()), user_region).groupBy("region", "month").count()
    return counts.select("region", month_key("month").alias("create_year_month"), F.col("count").alias("user_cnt"))
