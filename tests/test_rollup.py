"""Bitmap marts against counts of the raw rows, and the error of the opt-in estimates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.timekeys import month_start
from tidemark.operators import activity, rollup


@pytest.fixture(scope="module")
def logins(spark):
    rng = random.Random(4)
    users = [None, 0, 1, -1, -32_768, -32_769, 32_767, 32_768, 32_769, 65_536, 2**40, -(2**40), 2**62]
    users += [rng.randint(-100_000, 100_000) for _ in range(300)]
    days = [None] + [dt.date(2023, 11, 1) + dt.timedelta(d) for d in range(70)]
    rows = [(rng.choice(users), rng.choice(days)) for _ in range(4000)] * 2
    return spark.createDataFrame(rows, "user_id long, login_date date").cache()


def same(a, b):
    assert a.columns == b.columns
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_days_months_and_all_time(spark, logins):
    mart = rollup.day_bitmaps(rollup.user_days(logins)).cache()
    assert same(rollup.dau_of(mart), activity.dau(logins))
    assert same(rollup.mau_of(mart), activity.mau(logins))
    total = logins.filter("login_date is not null").select(F.count_distinct("user_id").alias("user_cnt"))
    assert same(rollup.users_of(mart), total)
    assert rollup.mau_of(rollup.day_bitmaps(rollup.user_days(logins.limit(0)))).collect() == []


def test_key_of_the_user(spark, logins):
    users = logins.filter("user_id is not null").groupBy("user_id").agg(F.min("login_date").alias("create_date"))
    days = rollup.user_days(logins).join(users.select("user_id", F.date_format("create_date", "yyyy").alias("create_year")), "user_id")
    mart = rollup.day_bitmaps(days, "create_year")
    assert same(rollup.au_by_key(mart, "create_year"), activity.au_by_signup(logins, users, "year"))
    assert same(rollup.mau_of(mart), activity.mau(logins))


def test_repeated_user_days_change_nothing(spark, logins):
    days = rollup.user_days(logins)
    assert same(rollup.mau_of(rollup.day_bitmaps(days.union(days))), activity.mau(logins))


def test_a_bitmap_is_made_once(spark):
    logins = spark.range(9).selectExpr("id % 3 AS user_id", "date_add(date'2024-01-01', CAST(id AS INT)) AS login_date")
    plan = rollup.day_bitmaps(rollup.user_days(logins))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the user-days, and the bits before they become bitmaps
    assert plan.index("Exchange hashpartitioning") > plan.rindex("bitmap_construct_agg")


def test_heavy_user_is_a_row_per_day(spark):
    rows = spark.range(0, 30_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("user_id"), F.lit("2024-01-05").cast("date").alias("login_date")
    )
    assert rollup.user_days(rows).filter("user_id = 0").count() == 1
    assert rollup.dau_of(rollup.day_bitmaps(rollup.user_days(rows))).first().dau == 20_001


@pytest.mark.parametrize("n", [3_000, 400_000])
def test_estimates_stay_within_three_errors(spark, n):
    rows = spark.range(0, 3 * n, 1, 6).select(
        (F.col("id") % n).alias("user_id"), F.date_add(F.lit("2024-01-20"), (F.col("id") % 23).cast("int")).alias("login_date")
    )
    sketches = rollup.day_sketches(rows)
    exact = rollup.day_bitmaps(rollup.user_days(rows)).cache()
    months = rollup.estimated_users(sketches, month_start("day").alias("month"))
    both = months.join(rollup.users_of(exact, month_start("day").alias("month")).withColumnRenamed("user_cnt", "exact"), "month")
    found = both.select("user_cnt", "exact", rollup.within_error("user_cnt", "exact").alias("near")).collect()
    assert len(found) == 2 and all(r.near for r in found)
    total = rollup.estimated_users(sketches).first().user_cnt
    assert abs(total - n) <= 3 * rollup.standard_error() * n
    assert all(abs(r.login_user_cnt - n) <= 3 * 0.02 * n for r in activity.mau(rows, approximate=0.02).collect() if r.login_user_cnt > 0.9 * n)


def test_exact_is_the_default(spark, logins):
    assert "approx" not in activity.mau(logins)._jdf.queryExecution().toString()
    assert "approx" in activity.dau(logins, approximate=0.05)._jdf.queryExecution().toString()
