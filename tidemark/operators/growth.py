"""Month-over-month growth of regions.

The inputs are finished counts, one row per region and month, so the windows
here never see facts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import GROWTH_BAND_LABELS, growth_band, recode
from tidemark.functions.ratios import growth
from tidemark.functions.timekeys import month_from_key, month_number


def region_growth(
    counts: DataFrame,
    ref_month: str,
    month: str = "login_year_month",
    region: str = "region",
    count: str = "user_cnt",
    calendar: bool = False,
) -> DataFrame:
    """Ordinal, previous count and growth per region, and the band of one month's growth.

    The previous count is that of the region's previous observed month.  With
    ``calendar`` it is that of the month before, null if that one was not observed.
    """
    by_month = Window.partitionBy(region).orderBy(month)
    previous = F.lag(count).over(by_month)
    if calendar:
        in_time = Window.partitionBy(region).orderBy(month_number(month_from_key(month)))
        previous = F.max(count).over(in_time.rangeBetween(-1, -1))
    rated = counts.select(
        region,
        month,
        F.row_number().over(by_month).alias("rank_asc"),
        count,
        previous.alias("bef_1m_user_cnt"),
    ).withColumn("rate_of_change", growth(count, "bef_1m_user_cnt"))
    at_ref = F.max(F.when(F.col(month) == ref_month, F.col("rate_of_change")))
    banded = rated.withColumn("ref_rate_of_change", at_ref.over(Window.partitionBy(region)))
    return banded.withColumn("user_group", growth_band("ref_rate_of_change"))


def region_au_nru_long(
    au_growth: DataFrame,
    nru_growth: DataFrame,
    labels: Mapping[str, str] = GROWTH_BAND_LABELS,
) -> DataFrame:
    """Both growth tables as one, tagged with ``category`` and with display texts for the bands."""
    au = au_growth.withColumnRenamed("login_year_month", "year_month").withColumn("category", F.lit("AU"))
    nru = nru_growth.withColumnRenamed("create_year_month", "year_month").withColumn("category", F.lit("NRU"))
    both = au.unionByName(nru, allowMissingColumns=True)
    return both.withColumn("user_group", recode("user_group", labels))
