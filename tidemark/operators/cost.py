"""Marketing cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ratios import total
from tidemark.functions.timekeys import day_of, month_key


def daily_cost(cost: DataFrame, date: str = "aggregate_date", amount: str = "cost") -> DataFrame:
    """Cost per day, with the month key of the day."""
    day = day_of(date).alias("aggregate_date")
    sums = cost.filter(F.col(date).isNotNull()).groupBy(day).agg(total(amount).alias("cost"))
    return sums.select("aggregate_date", month_key("aggregate_date").alias("aggregate_year_month"), "cost")


def monthly_cost(daily: DataFrame) -> DataFrame:
    """Cost per month, rolled up from :func:`daily_cost`."""
    return daily.groupBy("aggregate_year_month").agg(F.sum("cost").alias("cost"))
