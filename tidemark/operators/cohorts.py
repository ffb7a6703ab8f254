"""Return rates of signup cohorts.

The windows run over finished counts, never over facts: a cohort has one row per
month, and in the regional table at most one per month and region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import period_label
from tidemark.functions.predicates import month_between
from tidemark.functions.ratios import ratio
from tidemark.functions.timekeys import month_from_key, month_key, month_start, months_elapsed
from tidemark.operators.activity import monthly_activity
from tidemark.operators.joins import one_row_per_user, with_region
from tidemark.operators.reshape import melt

COHORT_COLUMNS = ("login_year_month", "create_year_month", "create_year", "time_order", "user_cnt", "first_user_cnt")


def cohort_return_rate(counts: DataFrame, true_elapsed: bool = False) -> DataFrame:
    """Size of each signup cohort relative to its first observed month.

    ``counts`` has one row per signup month and login month.  ``time_order``
    numbers the observed months of a cohort; with ``true_elapsed`` it counts the
    months since signup instead.
    """
    in_cohort = Window.partitionBy("create_year_month").orderBy("login_year_month")
    index = F.row_number().over(in_cohort) - 1
    if true_elapsed:
        index = months_elapsed(month_from_key("create_year_month"), month_from_key("login_year_month"))
    rated = counts.withColumns(
        {
            "create_year": F.substring("create_year_month", 1, 4),
            "time_order": period_label(index),
            "first_user_cnt": F.first("user_cnt").over(in_cohort),
        }
    )
    return rated.select(*COHORT_COLUMNS, ratio("user_cnt", "first_user_cnt").alias("return_rate"))


def cohort_return_rate_long(rates: DataFrame, from_month: str, rate: str = "return_rate") -> DataFrame:
    """Count and rate of the cohorts from ``from_month`` on, one row each."""
    kept = rates.filter(month_between("create_year_month", from_month))
    ids = ["create_year_month", "login_year_month", "create_year", "time_order"]
    return melt(kept, ids, ["user_cnt", rate]).orderBy("create_year_month", "login_year_month")


def regional_cohort_counts(logins: DataFrame, users: DataFrame, user_region: DataFrame) -> DataFrame:
    """Distinct active users per region, signup month and login month; ``unknown`` holds users without a region."""
    signups = one_row_per_user(users, "create_date").withColumn("create_month", month_start("create_date"))
    # Both user tables are already partitioned by user here, and so is the result.
    dated = signups.filter(F.col("create_month").isNotNull())
    members = with_region(dated, user_region).select("user_id", "region", "create_month")
    counts = monthly_activity(logins).join(members, "user_id").groupBy("region", "create_month", "login_month").count()
    return counts.select(
        "region",
        month_key("login_month").alias("login_year_month"),
        month_key("create_month").alias("create_year_month"),
        F.col("count").alias("user_cnt"),
    )


def rate_regional_cohorts(counts: DataFrame) -> DataFrame:
    """Return rate of each regional cohort relative to its own first observed month.

    ``time_order`` numbers the months in which the cohort was seen in any region.
    ``time_order_ranked`` ranks them over the rows of all regions and so leaves gaps.

    The window over a cohort sees one row per month and region, not users.
    Numbering the months apart and joining the numbers back would run the join
    of logins and users twice.
    """
    in_cohort = Window.partitionBy("create_year_month").orderBy("login_year_month")
    in_region = Window.partitionBy("region", "create_year_month").orderBy("login_year_month")
    rated = counts.withColumns(
        {
            "create_year": F.substring("create_year_month", 1, 4),
            "time_order": period_label(F.dense_rank().over(in_cohort) - 1),
            "time_order_ranked": period_label(F.rank().over(in_cohort) - 1),
            "first_user_cnt": F.first("user_cnt").over(in_region),
        }
    )
    return rated.select(
        "region", *COHORT_COLUMNS, "time_order_ranked", ratio("user_cnt", "first_user_cnt").alias("return_rate")
    )


def cohort_return_rate_by_region(logins: DataFrame, users: DataFrame, user_region: DataFrame) -> DataFrame:
    return rate_regional_cohorts(regional_cohort_counts(logins, users, user_region))
