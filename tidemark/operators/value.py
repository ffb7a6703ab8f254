"""Lifetime value and return on ad spend of signup cohorts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import cohort_complete
from tidemark.functions.ratios import money_ratio
from tidemark.functions.timekeys import day_of, end_of_last_full_month, month_key, month_start, months_elapsed
from tidemark.operators.attribution import attributed_signups
from tidemark.operators.joins import splittable_join

ALL = "all"
#: A written day, or a column without rows of its own such as :func:`observed_to` gives.
Day = dt.date | Column


def observed_to(orders: DataFrame, date: str = "order_date") -> Column:
    """The end of the last full month of orders, as a scalar subquery: Spark finds it while the plan runs.

    Where there are no dated orders it is null, and then no cohort was observed.
    """
    return orders.agg(end_of_last_full_month(F.max(day_of(date))).alias("observed_to")).scalar()


def user_spend(orders: DataFrame, user: str, date: str, amount: str) -> DataFrame:
    """(user_id, order_day, paid): a row per order of a known user and day."""
    known = orders.filter(F.col(user).isNotNull() & F.col(date).isNotNull())
    return known.select(F.col(user).alias("user_id"), day_of(date).alias("order_day"), F.col(amount).alias("paid"))


def user_daily_spend(orders: DataFrame, user: str, date: str, amount: str) -> DataFrame:
    """Spend per user and day, to be stored in buckets of users where several tables start from it.

    A heavy buyer, whatever part of all orders is theirs, is a row per day there.
    """
    spend = user_spend(orders, user, date, amount)
    return spend.groupBy("user_id", "order_day").agg(F.sum("paid").alias("paid"))


def cohort_members(users: DataFrame, by: str, with_all: bool, user: str = "user_id") -> DataFrame:
    """A row per user and value of ``by`` with the first signup day, and with ``with_all`` one per user under ``all``.

    A user with installs of two kinds is in the cohorts of both and once in
    ``all``, as in the signup counts.  A null ``by`` counts in ``all`` only.
    """
    known = users.filter(F.col(user).isNotNull()).select(
        F.col(user).alias("user_id"), day_of("create_date").alias("create_date"), by
    )
    first = F.min("create_date").alias("create_date")
    if with_all:
        label = F.when(F.grouping(by) == 1, ALL).otherwise(F.col(by)).alias("_label")
        members = known.groupingSets([["user_id", by], ["user_id"]], "user_id", by).agg(label, first)
        members = members.select("user_id", "create_date", F.col("_label").alias(by))
    else:
        members = known.groupBy("user_id", by).agg(first)
    return members.filter(F.col(by).isNotNull())


def cohort_revenue(
    users: DataFrame,
    orders: DataFrame,
    max_period: int | None,
    obs_end: Day,
    by: str = "attribute_type",
    with_all: bool = True,
    user: str = "user_id",
    date: str = "order_date",
    amount: str = "payment_amount",
) -> DataFrame:
    """Size and cumulative revenue of each signup cohort by months since signup.

    A cohort is a value of ``by`` and a signup ``month``, which is a DATE here.
    Its members are those of :func:`cohort_members`, so that cohorts of
    different values may share users and revenue.
    The size counts all members, buyers or not.  Periods run from 0 to the last
    one that had begun by ``obs_end``, or to ``max_period`` where one is given;
    one without orders repeats the last sum.

    The orders are shuffled once, as they are, to meet the members.
    """
    members = cohort_members(users, by, with_all, user)
    return revenue_of(members, user_spend(orders, user, date, amount), max_period, obs_end, by, splittable=True)


def revenue_of(
    members: DataFrame, spend: DataFrame, max_period: int | None, obs_end: Day, by: str, splittable: bool = False
) -> DataFrame:
    """:func:`cohort_revenue` from (user_id, create_date, ``by``) and from (user_id, order_day, paid).

    ``splittable`` is for spend that is not summed per user and day: it splits a
    heavy buyer.  Without it, two tables in buckets of users are not shuffled.
    """
    members = members.withColumn("month", month_start("create_date")).filter(F.col("month") <= F.lit(obs_end))
    spend = spend.filter(F.col("order_day") <= F.lit(obs_end))
    met = splittable_join(spend, members, "user_id") if splittable else members.join(spend, "user_id")
    # Orders before the signup are not the cohort's; equal days are.
    bought = met.filter(F.col("order_day") >= F.col("create_date"))
    period = months_elapsed("month", "order_day").alias("ltv_period")
    revenue = bought.select(by, "month", period, "paid")
    last_period = months_elapsed("month", F.lit(obs_end))
    if max_period is not None:
        revenue = revenue.filter(F.col("ltv_period") <= max_period)
        last_period = F.least(F.lit(max_period), last_period)
    revenue = revenue.groupBy(by, "month", "ltv_period").agg(F.sum("paid").alias("paid"))
    sizes = members.groupBy(by, "month").agg(F.count("*").alias("user_cnt"))

    observed = sizes.withColumn("_last", last_period).filter(F.col("_last") >= 0)
    periods = observed.withColumn("ltv_period", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    so_far = Window.partitionBy(by, "month").orderBy("ltv_period").rowsBetween(Window.unboundedPreceding, 0)
    filled = periods.join(revenue, [by, "month", "ltv_period"], "left")
    running = F.sum(F.coalesce("paid", F.lit(0))).over(so_far)
    return filled.select(by, "month", "ltv_period", "user_cnt", running.alias("revenue"))


def with_ltv(revenue: DataFrame) -> DataFrame:
    """Revenue per member, from :func:`cohort_revenue`; the month becomes ``yyyy-MM`` text."""
    return revenue.select(revenue.columns[0], *_value_columns())


def cohort_ltv(
    users: DataFrame,
    orders: DataFrame,
    max_period: int | None,
    obs_end: Day,
    by: str = "attribute_type",
    with_all: bool = True,
    **columns: str,
) -> DataFrame:
    """Cumulative spend per cohort member: :func:`cohort_revenue` with :func:`with_ltv`.

    ``columns`` may name the ``user`` column of both tables and the ``date`` and
    ``amount`` columns of the orders.
    """
    return with_ltv(cohort_revenue(users, orders, max_period, obs_end, by, with_all, **columns))


def _value_columns() -> list[Column]:
    return [
        month_key("month").alias("create_year_month"),
        F.col("ltv_period"),
        F.col("user_cnt"),
        F.col("revenue"),
        money_ratio("revenue", "user_cnt", 2).alias("ltv"),
    ]


def cost_by_month(cost: DataFrame, *keys: str) -> DataFrame:
    """Cost per month, and per ``keys`` where given; the month is a DATE."""
    dated = cost.filter(F.col("aggregate_date").isNotNull())
    return dated.groupBy(*keys, month_start("aggregate_date").alias("month")).agg(F.sum("cost").alias("cost"))


def with_roas(revenue: DataFrame, cost: DataFrame, keys: list[str], obs_end: Day, horizon: int = 1) -> DataFrame:
    """LTV and ROAS of the cohorts tracked for at least ``horizon`` months, from :func:`cohort_revenue`.

    ROAS is cumulative revenue over the cost of the signup month; with
    ``campaign`` among the ``keys`` over the campaign's own cost.  The month is
    a DATE up to here: Spark copies the filter to the cost rows, where comparing
    texts would mean formatting every single row.
    """
    closed = revenue.filter(cohort_complete("month", obs_end, horizon))
    spent = cost_by_month(cost, *[k for k in keys if k != "month"])
    roas = money_ratio("revenue", "cost", 4).alias("roas")
    return closed.join(spent, keys, "left").select(revenue.columns[0], *_value_columns(), "cost", roas)


def roas_by_attribute(
    users: DataFrame,
    orders: DataFrame,
    cost: DataFrame,
    max_period: int | None,
    obs_end: Day,
    horizon: int = 1,
) -> DataFrame:
    """ROAS per attribute type and signup month: cumulative revenue over the month's cost.

    Organic signups have no cost of their own; every type is set against the
    total cost of its signup month.
    """
    revenue = cohort_revenue(users, orders, max_period, obs_end)
    return with_roas(revenue, cost, ["month"], obs_end, horizon)


def roas_by_campaign(
    users: DataFrame,
    orders: DataFrame,
    cost: DataFrame,
    max_period: int | None,
    obs_end: Day,
    horizon: int = 1,
) -> DataFrame:
    """ROAS per campaign and signup month, against the campaign's own cost in that month."""
    revenue = cohort_revenue(users, orders, max_period, obs_end, by="campaign", with_all=False)
    return with_roas(revenue, cost, ["campaign", "month"], obs_end, horizon)


def install_cohorts(
    users: DataFrame, organic: DataFrame, non_organic: DataFrame, attribute: str = "attribute_type"
) -> DataFrame:
    """(user_id, create_date, attribute) of the signups that an install was found for, a row per value.

    A user with installs of two types or campaigns that day has a row for each.
    A null id stands for no one install, so it leads to no campaign; it keeps its type.
    """
    if attribute == "campaign":
        users = users.filter(F.col("attribute_id").isNotNull())
    matched = attributed_signups(users, organic, non_organic, attribute)
    return matched.filter(F.col(attribute).isNotNull()).distinct()


def cohort_ltv_by_install(
    users: DataFrame,
    organic: DataFrame,
    non_organic: DataFrame,
    orders: DataFrame,
    max_period: int | None = None,
    obs_end: Day | None = None,
) -> DataFrame:
    """:func:`cohort_ltv` of the signups by the type of their installs, and of all that have one under ``all``.

    The sizes are those of ``signup_counts(..., grain="month", with_all=True)``.
    """
    members = install_cohorts(users, organic, non_organic)
    return cohort_ltv(members, orders, max_period, observed_to(orders) if obs_end is None else obs_end)


def roas_by_install_campaign(
    users: DataFrame,
    organic: DataFrame,
    non_organic: DataFrame,
    orders: DataFrame,
    cost: DataFrame,
    max_period: int | None = None,
    obs_end: Day | None = None,
    horizon: int = 1,
) -> DataFrame:
    """:func:`roas_by_campaign` of the signups by the campaigns of their installs."""
    members = install_cohorts(users, organic, non_organic, "campaign")
    return roas_by_campaign(members, orders, cost, max_period, observed_to(orders) if obs_end is None else obs_end, horizon)
