"""Null, rounding and incomplete-window behaviour on small tables."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.labels import count_text, growth_band, joined_key, month_text, percent_text, recode
from tidemark.functions.predicates import cohort_complete, differs, in_months, month_between
from tidemark.functions.ratios import growth, money_ratio, ratio, ratio_or_zero
from tidemark.functions.timekeys import (
    add_days,
    day_of,
    month_from_key,
    month_key,
    months_elapsed,
    timestamp_of,
    year_key,
)
from tidemark.operators import activity, annotate, attribution, cohorts, cost, ordering, profile, sales, value
from tidemark.operators.joins import one_row_per_user
from tidemark.operators.reshape import melt

D = dt.date
INSTALL = "install_time timestamp_ntz, attribute_id string"
SIGNUP = "user_id long, attribute_id string, create_date date"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture
def signups(spark):
    return spark.createDataFrame(
        [
            (1, "a", D(2024, 1, 1)),  # two organic installs that day
            (2, "b", D(2024, 1, 1)),  # install on another day
            (3, None, D(2024, 1, 2)),  # null id, matched by a null id
            (4, "d", D(2024, 1, 2)),  # organic and non-organic
            (5, "e", None),  # no signup date
        ],
        SIGNUP,
    )


@pytest.fixture
def installs(spark):
    organic = spark.createDataFrame([(at(1), "a"), (at(1, 13), "a"), (at(2), "b"), (at(2, 5), "d"), (None, "e")], INSTALL)
    paid = spark.createDataFrame([(at(2, 9), None, "c1"), (at(2), "d", "c2")], INSTALL + ", campaign string")
    return organic, paid


def test_signups_without_install_vanish_and_null_ids_match(signups, installs, rows):
    got = rows(attribution.signups_by_attribution(signups, *installs))
    assert got == [
        {"create_date": D(2024, 1, 1), "attribute_type": "organic", "user_cnt": 1},
        {"create_date": D(2024, 1, 2), "attribute_type": "non_organic", "user_cnt": 2},
        {"create_date": D(2024, 1, 2), "attribute_type": "organic", "user_cnt": 1},
    ]


def test_unattributed_signups_can_be_kept(signups, installs):
    got = attribution.signups_by_attribution(signups, *installs, keep_unattributed=True)
    unknown = got.filter("attribute_type is null").collect()
    assert [(r.create_date, r.user_cnt) for r in unknown] == [(D(2024, 1, 1), 1)]


def test_all_counts_a_user_of_both_types_once(signups, installs):
    got = attribution.signups_by_attribution(signups, *installs, grain="month", with_all=True)
    assert {r.attribute_type: r.user_cnt for r in got.collect()} == {"all": 3, "organic": 2, "non_organic": 2}
    assert {r.create_year_month for r in got.collect()} == {"2024-01"}


def test_union_fills_an_absent_campaign(installs):
    got = attribution.tagged_installs(*installs)
    assert got.columns == ["attribute_type", "install_time", "attribute_id", "campaign"]
    assert {r.campaign for r in got.filter("attribute_type = 'organic'").collect()} == {None}
    assert "campaign" in attribution.tagged_installs(installs[0], installs[0]).columns


def test_inequality_keeps_nulls(spark):
    months = spark.createDataFrame([("2022-10",), ("2022-11",), (None,)], "m string")
    assert {r.m for r in months.filter(differs("m", "2022-11")).collect()} == {"2022-10", None}


def test_month_range_is_inclusive(spark):
    months = spark.createDataFrame([("2021-12",), ("2022-01",), ("2022-02",), ("2022-03",)], "m string")
    assert [r.m for r in months.filter(month_between("m", "2022-01", "2022-02")).collect()] == ["2022-01", "2022-02"]
    assert months.filter(month_between("m")).count() == 4
    days = spark.createDataFrame([(dt.datetime(2022, m, 28, 23),) for m in (1, 2, 3)], "t timestamp_ntz")
    assert [r.t.month for r in days.filter(in_months("t", "2022-02", "2022-02")).collect()] == [2]
    assert [r.t.month for r in days.filter(in_months("t", "2022-02")).collect()] == [2, 3]


def test_incomplete_cohorts(spark):
    months = spark.createDataFrame([(D(2022, m, 1),) for m in (9, 10, 11)], "m date")
    complete = months.filter(cohort_complete("m", D(2022, 11, 30), 1)).collect()
    assert [r.m.month for r in complete] == [9, 10]
    assert months.filter(cohort_complete("m", D(2023, 1, 1), 3)).count() == 2
    assert months.filter(cohort_complete("m", D(2022, 12, 31), 1)).count() == 3


def test_shop_with_only_null_payments_sells_zero(spark, rows):
    orders = spark.createDataFrame(
        [("x", None, 1), ("x", None, 1), ("y", Decimal("2.50"), 1), ("y", Decimal("1.00"), None), (None, Decimal("9"), 3)],
        "pickup_shop_name string, payment_amount decimal(18,2), user_id long",
    )
    assert rows(sales.shop_sales(orders)) == [
        {"pickup_shop_name": "x", "sales": Decimal("0.00"), "pu": 1},
        {"pickup_shop_name": "y", "sales": Decimal("3.50"), "pu": 1},
    ]


def test_shop_region_pivot(spark, rows):
    orders = spark.createDataFrame(
        [
            (at(5), "x", Decimal("1.00"), 1),
            (at(6), "x", Decimal("2.00"), 1),
            (at(6), "x", Decimal("4.00"), 2),
            (dt.datetime(2024, 2, 1), "x", Decimal("8.00"), 1),
            (at(7), "y", Decimal("5.00"), 9),
        ],
        "order_date timestamp_ntz, pickup_shop_name string, payment_amount decimal(18,2), user_id long",
    )
    regions = spark.createDataFrame([(1, "north"), (1, "north"), (2, "south"), (9, "else")], "user_id long, region string")
    wide = sales.shop_region_sales_pivot(orders, regions, ["north", "south", "west"], month="2024-01")
    assert rows(wide) == [
        {"order_year_month": "2024-01", "pickup_shop_name": "x", "north": 3, "south": 4, "west": None, "other": None},
        {"order_year_month": "2024-01", "pickup_shop_name": "y", "north": None, "south": None, "west": None, "other": 5},
    ]
    filled = sales.shop_region_sales_pivot(orders, regions, ["north", "west"], fill_zero=True)
    assert {(r.order_year_month, r.pickup_shop_name): (r.north, r.west, r.other) for r in filled.collect()} == {
        ("2024-01", "x"): (3, 0, 4),
        ("2024-02", "x"): (8, 0, 0),
        ("2024-01", "y"): (0, 0, 5),
    }
    # payers without a region count too: each shop's row adds up to its sales
    few = sales.shop_region_sales_pivot(orders, regions.filter("user_id = 1"), ["north"], fill_zero=True)
    got = few.groupBy("pickup_shop_name").agg(F.sum(F.col("north") + F.col("other")).alias("sales"))
    assert rows(got) == rows(sales.shop_sales(orders), "pickup_shop_name", "sales")


def test_users_without_a_region_count_as_unknown(spark, rows):
    users = spark.createDataFrame([(1, D(2024, 1, 1)), (2, D(2024, 1, 5)), (3, D(2024, 1, 9))], "user_id long, create_date date")
    regions = spark.createDataFrame([(1, "north"), (2, None)], "user_id long, region string")
    logins = users.selectExpr("user_id", "create_date as login_date")
    for counts in (
        activity.mau_by_region(logins, regions),
        activity.nru_by_region(users, regions),
        cohorts.regional_cohort_counts(logins, users, regions),
    ):
        assert {r.region: r.user_cnt for r in counts.collect()} == {"north": 1, "unknown": 2}


def test_cost_sums_rows_of_a_day(spark, rows):
    spent = spark.createDataFrame(
        [(D(2024, 1, 1), Decimal("1.10")), (D(2024, 1, 1), Decimal("2.20")), (D(2024, 2, 1), None), (None, Decimal("5"))],
        "aggregate_date date, cost decimal(18,2)",
    )
    daily = cost.daily_cost(spent)
    assert rows(daily) == [
        {"aggregate_date": D(2024, 1, 1), "aggregate_year_month": "2024-01", "cost": Decimal("3.30")},
        {"aggregate_date": D(2024, 2, 1), "aggregate_year_month": "2024-02", "cost": Decimal("0.00")},
    ]
    assert {r.aggregate_year_month: r.cost for r in cost.monthly_cost(daily).collect()} == {
        "2024-01": Decimal("3.30"),
        "2024-02": Decimal("0.00"),
    }


def test_unpivot_of_count_and_rate_gives_doubles(spark, rows):
    wide = spark.createDataFrame([("c", 3, Decimal("0.25"))], "id string, n long, rate decimal(5,4)")
    assert rows(melt(wide, ["id"], ["n", "rate"])) == [
        {"id": "c", "variable": "n", "value": 3.0},
        {"id": "c", "variable": "rate", "value": 0.25},
    ]
    assert dict(melt(wide, ["id"], ["n"]).dtypes)["value"] == "bigint"


def test_ratios(spark):
    one = spark.range(1).select(
        growth(F.lit(5), F.lit(0)).alias("from_zero"),
        ratio(F.lit(1), F.lit(32)).alias("tie"),
        ratio(F.lit(-1), F.lit(32)).alias("negative_tie"),
        ratio_or_zero(F.lit(0), F.lit(0)).alias("unknown"),
        money_ratio(F.lit(Decimal("1396935.63")), F.lit(6), 2).alias("money_tie"),
    )
    assert one.first().asDict() == {
        "from_zero": None,
        "tie": 0.0313,
        "negative_tie": -0.0313,
        "unknown": 0.0,
        "money_tie": 232822.61,
    }


def test_ratios_round_half_away_from_zero_on_the_exact_quotient(spark):
    rnd = random.Random(11)
    bases = [2, 5, 8, 16, 32, 64, 80, 125, 160, 320, 400, 625, 800, 1600, 2000, 20000]
    pairs = [(rnd.randrange(-5000, 5000), rnd.choice(bases)) for _ in range(1500)]
    pairs += [(rnd.randrange(-(10**9), 10**9), rnd.randrange(1, 10**6)) for _ in range(1500)]
    df = spark.createDataFrame(pairs, "top long, base long").select("top", "base", ratio("top", "base").alias("r"))
    for row in df.collect():
        exact = Decimal(row.top) / Decimal(row.base)
        assert row.r == float(exact.quantize(Decimal("0.0001"), ROUND_HALF_UP)), row


def test_growth_bands(spark):
    rates = spark.createDataFrame([(r,) for r in (None, -0.01, 0.0, 0.1, 0.11, 0.2, 0.3, 0.31)], "rate double")
    assert [r.band for r in rates.select(growth_band("rate").alias("band")).collect()] == [
        "new",
        "decrease",
        "increase_0_10",
        "increase_0_10",
        "increase_10_20",
        "increase_10_20",
        "increase_20_30",
        "increase_30_more",
    ]


def test_time_keys(spark):
    row = spark.range(1).select(
        month_key(F.lit("2022-05-17").cast("date")).alias("month"),
        year_key(F.lit("2022-05-17").cast("date")).alias("year"),
        month_from_key(F.lit("2022-05")).alias("first"),
        months_elapsed(F.lit(D(2021, 12, 31)), F.lit(D(2022, 2, 1))).alias("elapsed"),
        add_days(F.lit(D(2024, 2, 28)), 2).alias("later"),
        day_of(F.lit("2022-05-17 23:59:59")).alias("day"),
        timestamp_of(F.lit("2022-05-17 23:59:59")).alias("ts"),
    )
    assert row.first().asDict() == {
        "month": "2022-05",
        "year": "2022",
        "first": D(2022, 5, 1),
        "elapsed": 2,
        "later": D(2024, 3, 1),
        "day": D(2022, 5, 17),
        "ts": dt.datetime(2022, 5, 17, 23, 59, 59),
    }


def test_malformed_date_raises(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("not a date",)], "t string").select(timestamp_of("t")).collect()


def test_display_texts(spark):
    row = spark.range(1).select(
        count_text(F.lit(1234567)).alias("count"),
        percent_text(F.lit(0.1915)).alias("percent"),
        percent_text(F.lit(Decimal("0.5")), 0).alias("whole"),
        month_text(F.lit(D(2022, 5, 1))).alias("month"),
        joined_key(F.lit("양천구"), F.lit("목동")).alias("region"),
        recode(F.lit("b"), {"a": "A", "b": "B"}).alias("recoded"),
        recode(F.lit("z"), {"a": "A"}).alias("kept"),
    )
    assert list(row.first()) == ["1,234,567명", "19.2%", "50%", "05월", "양천구-목동", "B", "z"]


def test_activity_ignores_nulls_and_repeats(spark, rows):
    logins = spark.createDataFrame(
        [(1, at(1)), (1, at(1, 5)), (1, at(9)), (2, at(1)), (None, at(1)), (2, None), (2, dt.datetime(2024, 2, 1))],
        "user_id long, login_date timestamp_ntz",
    )
    assert {r.login_year_month: r.login_user_cnt for r in activity.mau(logins).collect()} == {"2024-01": 2, "2024-02": 1}
    assert {r.login_date.day: r.dau for r in activity.dau(logins.filter("login_date < '2024-02-01'")).collect()} == {1: 2, 9: 1}


def test_month_series_keeps_months_of_either_side(spark, rows):
    mau = spark.createDataFrame([("2022-05", 10), ("2022-06", 12)], "login_year_month string, login_user_cnt long")
    nru = spark.createDataFrame([("2021-12", 1), ("2022-04", 3), ("2022-05", 4)], "create_year_month string, user_cnt long")
    assert rows(activity.mau_nru_series(mau, nru, start="2022-01")) == [
        {"year_month": "2022-04", "mau": None, "nru": 3, "is_latest": False},
        {"year_month": "2022-05", "mau": 10, "nru": 4, "is_latest": False},
        {"year_month": "2022-06", "mau": 12, "nru": None, "is_latest": True},
    ]


def test_repeated_users_count_once_by_earliest_signup(spark, rows):
    users = spark.createDataFrame(
        [(1, D(2022, 3, 1)), (1, D(2022, 1, 5)), (2, D(2022, 3, 2)), (3, None)], "user_id long, create_date date"
    )
    logins = spark.createDataFrame(
        [(1, D(2022, 4, 1)), (1, D(2022, 4, 2)), (2, D(2022, 4, 2)), (3, D(2022, 4, 2))], "user_id long, login_date date"
    )
    assert rows(activity.au_by_signup(logins, users)) == [
        {"login_year_month": "2022-04", "create_year_month": "2022-01", "user_cnt": 1},
        {"login_year_month": "2022-04", "create_year_month": "2022-03", "user_cnt": 1},
    ]
    assert rows(activity.au_by_signup(logins, users, "year")) == [
        {"login_year_month": "2022-04", "create_year": "2022", "user_cnt": 2}
    ]
    several = spark.createDataFrame([(1, 5, None), (1, 5, "b"), (1, 7, "a")], "user_id long, day long, kind string")
    assert rows(one_row_per_user(several, "day", "kind")) == [{"user_id": 1, "day": 5, "kind": "b"}]


ORDER = "user_id long, order_date timestamp_ntz, payment_amount decimal(18,2)"


def test_ltv_counts_members_who_never_buy_and_fills_periods(spark):
    users = spark.createDataFrame(
        [(1, D(2024, 1, 10), "organic"), (2, D(2024, 1, 20), "organic"), (3, D(2024, 1, 5), None)],
        "user_id long, create_date date, attribute_type string",
    )
    orders = spark.createDataFrame(
        [
            (1, at(9), Decimal("100")),  # before the signup
            (1, at(10), Decimal("10")),  # on the day
            (1, dt.datetime(2024, 3, 1), Decimal("20")),
            (3, dt.datetime(2024, 2, 1), Decimal("6")),
            (1, dt.datetime(2024, 5, 1), Decimal("7")),  # after the observed time
        ],
        ORDER,
    )
    got = value.cohort_ltv(users, orders, max_period=5, obs_end=D(2024, 4, 30)).collect()
    curves = {}
    for r in sorted(got, key=lambda r: r.ltv_period):
        assert r.user_cnt == {"organic": 2, "all": 3}[r.attribute_type]
        curves.setdefault(r.attribute_type, []).append((r.ltv_period, float(r.revenue), r.ltv))
    assert curves == {
        "organic": [(0, 10.0, 5.0), (1, 10.0, 5.0), (2, 30.0, 15.0), (3, 30.0, 15.0)],
        "all": [(0, 10.0, 3.33), (1, 16.0, 5.33), (2, 36.0, 12.0), (3, 36.0, 12.0)],
    }


def test_ltv_of_tables_with_other_column_names(spark):
    users = spark.createDataFrame([(1, D(2024, 1, 1), "x")], "member long, create_date date, kind string")
    orders = spark.createDataFrame([(1, at(5), 7.5)], "member long, at timestamp_ntz, paid_total double")
    got = value.cohort_ltv(
        users, orders, 0, D(2024, 1, 31), by="kind", with_all=False, user="member", date="at", amount="paid_total"
    ).collect()
    assert [(r.kind, r.create_year_month, r.revenue, r.ltv) for r in got] == [("x", "2024-01", 7.5, 7.5)]


def test_user_with_two_kinds_of_install_is_in_both_cohorts(spark):
    users = spark.createDataFrame(
        [(1, D(2024, 1, 10), "organic"), (1, D(2024, 1, 10), "non_organic"), (1, D(2024, 1, 10), "non_organic"), (2, D(2024, 1, 5), "organic")],
        "user_id long, create_date date, attribute_type string",
    )
    orders = spark.createDataFrame([(1, at(12), Decimal("10")), (2, at(12), Decimal("4"))], ORDER)
    got = value.cohort_ltv(users, orders, max_period=None, obs_end=D(2024, 1, 31)).collect()
    assert {(r.attribute_type, r.user_cnt, float(r.revenue)) for r in got} == {
        ("organic", 2, 14.0), ("non_organic", 1, 10.0), ("all", 2, 14.0)
    }


def test_roas_divides_by_cost_of_the_signup_month(spark):
    users = spark.createDataFrame(
        [(1, D(2024, 1, 1), "c1"), (2, D(2024, 2, 1), "c1"), (3, D(2024, 1, 1), "c2")],
        "user_id long, create_date date, campaign string",
    )
    orders = spark.createDataFrame([(1, at(3), Decimal("30")), (2, dt.datetime(2024, 2, 2), Decimal("1"))], ORDER)
    spent = spark.createDataFrame(
        [(D(2024, 1, 1), "c1", Decimal("8")), (D(2024, 1, 31), "c1", Decimal("4")), (D(2024, 2, 1), "c1", Decimal("1"))],
        "aggregate_date date, campaign string, cost decimal(18,2)",
    )
    got = value.roas_by_campaign(users, orders, spent, max_period=0, obs_end=D(2024, 2, 29), horizon=1).collect()
    # the February cohort is not closed; c2 spent nothing
    assert {(r.campaign, r.create_year_month): r.roas for r in got} == {("c1", "2024-01"): 2.5, ("c2", "2024-01"): None}


def test_periods_are_closed_and_may_overlap(spark, rows):
    days = spark.createDataFrame([(D(2024, 1, d),) for d in (1, 2, 3, 4)], "day date")
    periods = annotate.period_table(spark, [(D(2024, 1, 2), D(2024, 1, 3), "p"), (D(2024, 1, 3), D(2024, 1, 3), "it's")])
    got = annotate.annotate_periods(days, periods, "day")
    assert sorted((r.day.day, r.note or "") for r in got.collect()) == [(1, ""), (2, "p"), (3, "it's"), (3, "p"), (4, "")]


def test_profile_and_value_counts(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2), ("b", 3)], "k string, n long")
    assert rows(profile.profile(df)) == [
        {"column_name": "k", "data_type": "string", "non_null_cnt": 3, "row_cnt": 4},
        {"column_name": "n", "data_type": "bigint", "non_null_cnt": 3, "row_cnt": 4},
    ]
    assert [tuple(r) for r in profile.value_counts(df, "k").collect()] == [("a", 2), ("b", 1)]


def test_category_order_puts_unknown_values_last(spark):
    df = spark.createDataFrame([("z",), ("a",), ("b",), ("c",)], "k string")
    assert [r.k for r in ordering.order_by_category(df, "k", ["c", "a"]).collect()] == ["c", "a", "b", "z"]
    assert [r.k for r in ordering.head(df, "k", n=2).collect()] == ["a", "b"]
