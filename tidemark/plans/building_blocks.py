"""Scans, sinks, filters, orders and labels that no metric table shows on its own."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import count_text, month_text, percent_text
from tidemark.functions.predicates import differs, in_months, month_between
from tidemark.functions.timekeys import day_of, month_from_key, timestamp_of
from tidemark.operators import activity, attribution, cohorts, ordering, sales
from tidemark.plans import metrics
from tidemark.plans import star_inputs as inputs
from tidemark.plans.registry import ORACLES, query
from tidemark.plans.sql_parts import (
    EVENT_USERS,
    INSTALLS,
    ORDER_LOGINS,
    ORDER_USERS,
    SALES,

    month,
)
from tidemark.session import scratch_path
from tidemark.sources import tables
from tidemark.sources.schemas import SCHEMAS

LAST_EVENT_DAY = dt.date(2024, 1, 30)  # the events of this day are not complete
AXIS_REGIONS = ("EUROPE", "ASIA", "AFRICA")


# --- sources and sinks ------------------------------------------------------


@query(ORACLES["au_by_signup_month"])
def csv_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric table written as CSV and read back with its schema."""
    root = scratch_path(spark, "exchange")
    tables.write_csv(metrics.au_by_signup_month(spark, sf_dir), os.path.join(root, "au_by_signup_month.csv"))
    return tables.load_table(spark, root, "au_by_signup_month")


@query(f"""
WITH {ORDER_LOGINS}, {ORDER_USERS}
SELECT {month('login_date')} AS login_year_month, strftime(create_date, '%Y') AS create_year,
       count(DISTINCT user_id) AS user_cnt
FROM logins JOIN users USING (user_id) WHERE login_date >= DATE '2000-01-01' GROUP BY 1, 2""")
def mart_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric table written by month, and a second table made from the months it needs."""
    path = scratch_path(spark, "au_by_signup_month")
    tables.write_mart(metrics.au_by_signup_month(spark, sf_dir), path, month="login_year_month")
    mart = tables.read_mart(spark, path, SCHEMAS["au_by_signup_month"])
    recent = mart.filter(month_between("login_year_month", "2000-01"))
    by_year = recent.groupBy("login_year_month", F.substring("create_year_month", 1, 4).alias("create_year"))
    return by_year.agg(F.sum("user_cnt").alias("user_cnt"))


# --- union, projection and filters ------------------------------------------


@query(f"WITH {INSTALLS} SELECT * FROM installs")
def tagged_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.tagged_installs(
        inputs.organic_installs(spark, sf_dir), inputs.non_organic_installs(spark, sf_dir)
    )


@query(f"""
WITH {INSTALLS}
SELECT * FROM installs
WHERE campaign IS DISTINCT FROM '5' AND CAST(install_time AS DATE) IS DISTINCT FROM DATE '2024-01-30'""")
def installs_outside_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installs outside one campaign, those without a campaign included, up to the day before the last."""
    installs = tagged_installs(spark, sf_dir)
    return installs.filter(differs("campaign", "5") & differs(day_of("install_time"), LAST_EVENT_DAY))


@query(f"SELECT * FROM ({ORACLES['cohort_ltv']}) WHERE attribute_type = 'organic'")
def organic_ltv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cohort_ltv(spark, sf_dir).filter(F.col("attribute_type") == "organic")


@query(f"""
SELECT * FROM ({ORACLES['nru']}) WHERE create_year_month BETWEEN '1995-03' AND '1996-02'""")
def nru_of_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nru(spark, sf_dir).filter(month_between("create_year_month", "1995-03", "1996-02"))


@query(f"""
SELECT * FROM ({ORACLES['mau']}) WHERE login_year_month >= '2000-10'""")
def mau_of_recent_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month range as a filter on the logins, where the scan can use it."""
    return activity.mau(inputs.order_logins(spark, sf_dir).filter(in_months("login_date", "2000-10")))


@query(f"""
WITH {EVENT_USERS}, {INSTALLS},
typed AS (
    SELECT create_date, attribute_type, user_id FROM users JOIN installs USING (attribute_id)
    WHERE create_date = CAST(install_time AS DATE)),
both_types AS (SELECT * FROM typed UNION ALL SELECT create_date, 'all', user_id FROM typed)
SELECT {month('create_date')} AS create_year_month, attribute_type, count(DISTINCT user_id) AS user_cnt
FROM both_types GROUP BY 1, 2""")
def signups_monthly_with_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.signups_by_attribution(
        inputs.event_users(spark, sf_dir),
        inputs.organic_installs(spark, sf_dir),
        inputs.non_organic_installs(spark, sf_dir),
        grain="month",
        with_all=True,
    )


# --- lookups and orders -----------------------------------------------------


@query(f"""
WITH {SALES}
SELECT pickup_shop_name, CAST(sum(payment_amount) AS DOUBLE) AS sales, count(DISTINCT user_id) AS pu,
       any_value(r_name) AS region_1depth_name, any_value(n_name) AS region_2depth_name
FROM sales JOIN supplier ON s_name = pickup_shop_name
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def shop_sales_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.shop_sales_located(metrics.shop_sales(spark, sf_dir), inputs.shop_places(spark, sf_dir))


@query(f"""
WITH {SALES}
SELECT shop_region AS pickup_shop_name, CAST(sum(payment_amount) AS DOUBLE) AS sales, count(DISTINCT user_id) AS pu,
       CASE shop_region WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'AFRICA' THEN 3 ELSE 4 END AS axis_position
FROM sales GROUP BY 1""")
def shop_sales_in_category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_region = sales.shop_sales(inputs.shop_region_orders(spark, sf_dir))
    placed = by_region.withColumn(
        "axis_position", ordering.category_position("pickup_shop_name", AXIS_REGIONS).cast("int")
    )
    return ordering.order_by_category(placed, "pickup_shop_name", AXIS_REGIONS)


@query(f"SELECT * FROM ({ORACLES['cohort_ltv']}) ORDER BY attribute_type, create_year_month, ltv_period LIMIT 5")
def ltv_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.head(metrics.cohort_ltv(spark, sf_dir), "attribute_type", "create_year_month", "ltv_period")


# --- dates and display texts ------------------------------------------------


@query("""
SELECT CAST(o_orderdate AS DATE) AS order_day, count(*) AS orders, count(o_orderdate) AS parsed
FROM orders GROUP BY 1""")
def dates_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates carried as text, parsed and counted per day."""
    texts = inputs.read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("string").alias("order_date"))
    parsed = texts.withColumn("order_date", timestamp_of("order_date"))
    days = parsed.groupBy(day_of("order_date").alias("order_day"))
    return days.agg(F.count("*").alias("orders"), F.count("order_date").alias("parsed"))


@query(f"""
SELECT create_year_month, login_year_month, format('{{:,}}', user_cnt) || '명' AS users_text,
       format('{{:.1f}}%', ((CAST(round(return_rate * 10000) AS BIGINT) + 5) // 10) / 10) AS rate_text,
       substr(login_year_month, 6, 2) || '월' AS month_text
FROM ({ORACLES['cohort_return_rate']})""")
def cohort_display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = cohorts.cohort_return_rate(metrics.au_by_signup_month(spark, sf_dir))
    return rates.select(
        "create_year_month",
        "login_year_month",
        count_text("user_cnt").alias("users_text"),
        percent_text("return_rate").alias("rate_text"),
        month_text(month_from_key("login_year_month")).alias("month_text"),
    )
