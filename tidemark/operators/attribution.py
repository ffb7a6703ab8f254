"""Signups by the kind of install that brought them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timekeys import day_of, month_key, month_start
from tidemark.operators.joins import null_safe_left_join

INSTALL_COLUMNS = ("attribute_type", "install_time", "attribute_id", "campaign")


def tagged_installs(organic: DataFrame, non_organic: DataFrame) -> DataFrame:
    """Both install tables as one, tagged with ``attribute_type``.

    Columns are matched by name; a campaign that one side lacks is null there.
    """
    both = organic.withColumn("attribute_type", F.lit("organic")).unionByName(
        non_organic.withColumn("attribute_type", F.lit("non_organic")), allowMissingColumns=True
    )
    if "campaign" not in both.columns:
        both = both.withColumn("campaign", F.lit(None).cast("string"))
    return both.select(*INSTALL_COLUMNS)


def attributed_signups(
    users: DataFrame, organic: DataFrame, non_organic: DataFrame, attribute: str | Sequence[str] = "attribute_type"
) -> DataFrame:
    """Signups with the types (or campaigns, or both) of install seen for the same attribution id on the same day.

    A null id matches a null id.  The attribute is null where nothing matched.
    ``attribute_id`` among the attributes is that of the signup.

    Installs are reduced to one row per id, day and attribute before the join,
    which keeps the join from multiplying rows.  An id shared by many signups
    (the null id above all) is then split over tasks by adaptive execution;
    that needs the join to shuffle the installs itself, so the reduction must
    not leave them partitioned on just the join keys.
    """
    attributes = [attribute] if isinstance(attribute, str) else list(attribute)
    installs = tagged_installs(organic, non_organic).select(
        F.col("attribute_id").alias("install_id"),
        day_of("install_time").alias("install_day"),
        *[a for a in attributes if a != "attribute_id"],
    )
    signups = users.select("user_id", "attribute_id", day_of("create_date").alias("create_date"))
    return null_safe_left_join(
        signups.filter(F.col("create_date").isNotNull()),
        installs.distinct(),
        [("attribute_id", "install_id"), ("create_date", "install_day")],
    ).select("user_id", "create_date", *attributes)


def signup_counts(
    attributed: DataFrame, grain: str = "day", keep_unattributed: bool = False, with_all: bool = False
) -> DataFrame:
    """Distinct signups per day or month and attribute type, in that order, from :func:`attributed_signups`.

    Signups without a matching install are left out unless ``keep_unattributed``.
    ``with_all`` adds the type ``all``: a user of both types counts once there.
    """
    period, column = {
        "day": (F.col("create_date"), "create_date"),
        "month": (month_start("create_date"), "create_year_month"),
    }[grain]
    if not keep_unattributed:
        attributed = attributed.filter(F.col("attribute_type").isNotNull())
    signups = attributed.select(period.alias(column), "attribute_type", "user_id")
    distinct_users = F.count_distinct("user_id").alias("user_cnt")
    if with_all:
        keys = [column, "attribute_type"]
        kind = F.when(F.grouping("attribute_type") == 1, "all").otherwise(F.col("attribute_type")).alias("kind")
        counts = signups.groupingSets([keys, keys[:1]], *keys).agg(kind, distinct_users)
        counts = counts.select(column, F.col("kind").alias("attribute_type"), "user_cnt")
    else:
        counts = signups.groupBy(column, "attribute_type").agg(distinct_users)
    if grain == "month":
        counts = counts.withColumn(column, month_key(column))
    return counts.orderBy(column, "attribute_type")


def signups_by_attribution(
    users: DataFrame,
    organic: DataFrame,
    non_organic: DataFrame,
    grain: str = "day",
    keep_unattributed: bool = False,
    with_all: bool = False,
) -> DataFrame:
    """:func:`signup_counts` straight from the signup and install tables."""
    return signup_counts(attributed_signups(users, organic, non_organic), grain, keep_unattributed, with_all)
