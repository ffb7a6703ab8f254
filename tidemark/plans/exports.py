"""All metric tables from the raw tables, written for other tools.

The raw orders and logins are read once.  Orders are written by month; what needs one
month reads its folder, and spend is summed per user and day once and kept in buckets
of users.  Logins are reduced to a row per user and month with a bit per day, in the
same buckets: every table about activity starts from there and joins the users
without shuffling it again.  Signups are matched with installs once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timekeys import day_of
from tidemark.operators import activity, annotate, attribution, cohorts, cost, growth, profile, retention, sales, value
from tidemark.session import Scratch, scratch_path
from tidemark.sources import facts
from tidemark.sources.exchange import write_table
from tidemark.sources.tables import buckets_for, load_table, write_by_user, write_mart

RAW_TABLES = ("orders", "login", "users", "organic_install", "non_organic_install", "daily_cost", "user_region")
#: Without it there is no table of located shops.
SHOPS = "pickup_shop"


@dataclass(frozen=True)
class Settings:
    """What the tables cannot tell themselves."""

    ref_month: str  # month whose growth names a region's band
    regions: Sequence[str]  # columns of the shop by region table
    obs_end: dt.date | None = None  # last observed day; the end of the last full month of orders if not given
    max_period: int | None = None  # months of lifetime value, all that were observed unless given
    series_start: str | None = None  # first month of the activity series
    cohorts_from: str = "0000-00"  # first signup month of the long cohort table
    periods: Sequence[tuple[dt.date | None, dt.date | None, str]] = ()  # marked in the series of days
    buckets: int | None = None  # of the tables by user; by the size of the logins if not given


def load_raw_tables(spark: SparkSession, root: str, shops: bool = False) -> dict[str, DataFrame]:
    names = (*RAW_TABLES, SHOPS) if shops else RAW_TABLES
    return {name: load_table(spark, root, name) for name in names}


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A small table kept in the shared scratch folder, so that two metrics do not compute it twice."""
    path = scratch_path(spark, name)
    write_mart(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _until(df: DataFrame, date: str, obs_end: dt.date | None) -> DataFrame:
    """Rows up to the last observed day, and those without a date."""
    return df if obs_end is None else df.filter(F.col(date).isNull() | (day_of(date) <= F.lit(obs_end)))


def metric_tables(spark: SparkSession, raw: Mapping[str, DataFrame], settings: Settings) -> dict[str, DataFrame]:
    """Every metric table by name.  ``raw`` holds the tables of ``RAW_TABLES``, and may hold that of the shops.

    Nothing later than ``settings.obs_end`` counts in any of them.  The tables
    read scratch tables: use them within an open :class:`tidemark.session.Scratch`,
    or leave these to the end of the session.
    """
    obs_end, regions = settings.obs_end, raw["user_region"]
    users, logins = _until(raw["users"], "create_date", obs_end), _until(raw["login"], "login_date", obs_end)
    buckets = settings.buckets or buckets_for(raw["login"])

    def by_user(df: DataFrame, name: str) -> DataFrame:
        return write_by_user(spark, df, scratch_path(spark, name), buckets)

    at = scratch_path(spark, "orders")
    facts.store_load(_until(raw["orders"], "order_date", obs_end), at, "order_date", "all")
    stored = facts.read_facts(spark, at, raw["orders"].schema)
    ref_orders = facts.read_facts(spark, at, raw["orders"].schema, settings.ref_month, settings.ref_month)
    spend = by_user(value.user_daily_spend(stored, "user_id", "order_date", "payment_amount"), "spend")
    observed = value.observed_to(stored) if obs_end is None else obs_end

    user_months = by_user(retention.user_months(logins), "user_months")
    monthly = user_months.select("user_id", F.col("month").alias("login_date"))
    day_totals = _written(spark, retention.user_day_totals(user_months, users), "user_day_totals")

    attributes = ("attribute_id", "attribute_type", "campaign")
    installs = raw["organic_install"], raw["non_organic_install"]
    matched = by_user(attribution.attributed_signups(users, *installs, attributes).distinct(), "signups")
    # a null id names no install, so it leads to no campaign
    with_id = matched.withColumn("campaign", F.when(F.col("attribute_id").isNotNull(), F.col("campaign")))

    def revenue(by: str, with_all: bool) -> DataFrame:
        members = value.cohort_members(with_id, by, with_all)
        return value.revenue_of(members, spend, settings.max_period, observed, by)

    by_type = _written(spark, revenue("attribute_type", True), "cohort_revenue")
    daily_cost = cost.daily_cost(raw["daily_cost"])
    mau, nru = activity.mau(monthly), activity.nru(users)
    mau_growth = _written(spark, growth.region_growth(activity.mau_by_region(monthly, regions), settings.ref_month), "mau_growth")
    nru_counts = activity.nru_by_region(users, regions)
    nru_growth = _written(spark, growth.region_growth(nru_counts, settings.ref_month, month="create_year_month"), "nru_growth")
    by_signup_month = activity.au_by_signup(monthly, users)
    return_rate = _written(spark, cohorts.cohort_return_rate(by_signup_month), "cohort_return_rate")
    dau = day_totals.select("login_date", "dau")
    daily_retention = retention.daily_rates(day_totals, obs_end=obs_end)
    monthly_retention = retention.monthly_rates(day_totals, obs_end=obs_end)

    def shop_regions(fill_zero: bool) -> DataFrame:
        return sales.shop_region_sales_pivot(ref_orders, regions, settings.regions, settings.ref_month, fill_zero)

    shop_sales = sales.shop_sales(stored)
    tables = {
        "orders_profile": profile.profile(stored.drop(facts.MONTH, facts.LOAD)),
        "shop_sales": shop_sales,
        "shop_sales_monthly": sales.shop_sales_monthly(stored),
        "shop_region_sales": shop_regions(fill_zero=False),
        "shop_region_sales_filled": shop_regions(fill_zero=True),
        "daily_cost": daily_cost,
        "monthly_cost": cost.monthly_cost(daily_cost),
        "signups_daily": attribution.signup_counts(matched),
        "signups_monthly": attribution.signup_counts(matched, grain="month"),
        "cohort_ltv": value.with_ltv(by_type),
        "roas_by_attribute": value.with_roas(by_type, raw["daily_cost"], ["month"], observed),
        "roas_by_campaign": value.with_roas(revenue("campaign", False), raw["daily_cost"], ["campaign", "month"], observed),
        "dau": dau,
        "mau": mau,
        "nru": nru,
        "mau_nru_series": activity.mau_nru_series(mau, nru, settings.series_start),
        "mau_by_region_growth": mau_growth,
        "nru_by_region_growth": nru_growth,
        "region_au_nru": growth.region_au_nru_long(mau_growth, nru_growth),
        "au_by_signup_year": activity.au_by_signup(monthly, users, "year"),
        "au_by_signup_month": by_signup_month,
        "cohort_return_rate": return_rate,
        "cohort_return_rate_long": cohorts.cohort_return_rate_long(return_rate, settings.cohorts_from),
        "cohort_return_rate_by_region": cohorts.cohort_return_rate_by_region(monthly, users, regions),
        "nday_retention_daily": daily_retention,
        "nday_retention_daily_long": retention.retention_long(daily_retention),
        "nday_retention_monthly": monthly_retention,
        "nday_retention_monthly_long": retention.retention_long(monthly_retention),
    }
    if settings.periods:
        periods = annotate.period_table(spark, settings.periods)
        tables["period_annotated_dau"] = annotate.annotate_periods(dau, periods, "login_date")
    if SHOPS in raw:
        tables["shop_sales_located"] = sales.shop_sales_located(shop_sales, raw[SHOPS])
    return tables


def write_csv_tables(tables: Mapping[str, DataFrame], out: str) -> None:
    """One CSV folder per table, with its schema beside it; ``exchange.read_table`` reads it back."""
    for name, table in tables.items():
        write_table(table, out, name)


def export(spark: SparkSession, root: str, out: str, settings: Settings, shops: bool = False) -> list[str]:
    """All metric tables of the raw tables under ``root``, written to ``out``; scratch tables are gone afterwards."""
    with Scratch(spark):
        tables = metric_tables(spark, load_raw_tables(spark, root, shops), settings)
        write_csv_tables(tables, out)
    return sorted(tables)
