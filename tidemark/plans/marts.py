"""Metrics by way of stored tables: marts of user bitmaps, facts by month, refreshed marts, and CSV with its faults."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timekeys import month_key, month_start, year_key
from tidemark.operators import activity, rollup
from tidemark.operators.joins import one_row_per_user
from tidemark.plans import metrics
from tidemark.plans import star_inputs as inputs
from tidemark.plans.registry import ORACLES, query
from tidemark.plans.sql_parts import EVENT_LOGINS, ORDER_LOGINS, ORDER_USERS, month
from tidemark.session import scratch_path
from tidemark.sources import exchange, facts, quarantine, tables
from tidemark.sources.schemas import SCHEMAS


def _stored(spark: SparkSession, days: DataFrame, name: str) -> DataFrame:
    """A table of days written by month and read again."""
    path, dated = scratch_path(spark, name), days.withColumn("month", month_key("day"))
    tables.write_mart(dated, path, month="month")
    return tables.read_mart(spark, path, dated.schema)


def _order_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of each day by their signup year."""
    signups = one_row_per_user(inputs.order_users(spark, sf_dir), "create_date")
    years = signups.select("user_id", year_key("create_date").alias("create_year"))
    days = rollup.user_days(inputs.order_logins(spark, sf_dir)).join(years, "user_id")
    return _stored(spark, rollup.day_bitmaps(days, "create_year"), "order_bitmaps")


@query(ORACLES["dau"])
def dau_from_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = rollup.user_days(inputs.event_logins(spark, sf_dir))
    return rollup.dau_of(_stored(spark, rollup.day_bitmaps(days), "event_bitmaps"))


@query(ORACLES["mau"])
def mau_from_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.mau_of(_order_bitmaps(spark, sf_dir))


@query(ORACLES["au_by_signup_year"])
def au_by_signup_year_from_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.au_by_key(_order_bitmaps(spark, sf_dir), "create_year")


@query(f"""
WITH {ORDER_LOGINS}
SELECT strftime(login_date, '%Y') AS year, count(DISTINCT user_id) AS user_cnt FROM logins GROUP BY 1
UNION ALL SELECT 'all', count(DISTINCT user_id) FROM logins""")
def yearly_and_total_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active users of each year and of all time: unions of the same days."""
    mart = _order_bitmaps(spark, sf_dir)
    years = rollup.users_of(mart, F.trunc("day", "year").alias("first_day")).select(year_key("first_day").alias("year"), "user_cnt")
    return years.unionByName(rollup.users_of(mart).select(F.lit("all").alias("year"), "user_cnt"))


@query(f"SELECT *, TRUE AS within_error FROM ({ORACLES['mau']})")
def mau_estimate_beside_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opt-in estimate, merged from a sketch per day, against the exact count of each month."""
    sketches = _stored(spark, rollup.day_sketches(inputs.order_logins(spark, sf_dir)), "order_sketches")
    estimated = rollup.estimated_users(sketches, month_start("day").alias("month"))
    estimated = estimated.select(month_key("month").alias("login_year_month"), F.col("user_cnt").alias("estimate"))
    exact = rollup.mau_of(_order_bitmaps(spark, sf_dir))
    near = rollup.within_error("estimate", "login_user_cnt").alias("within_error")
    return exact.join(estimated, "login_year_month").select("login_year_month", "login_user_cnt", near)


@query(f"""
WITH {EVENT_LOGINS}
SELECT login_date, count(DISTINCT user_id) AS dau, TRUE AS within_error FROM logins GROUP BY 1""")
def dau_estimate_beside_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    logins = inputs.event_logins(spark, sf_dir)
    sketches = _stored(spark, rollup.day_sketches(logins), "event_sketches")
    estimated = rollup.estimated_users(sketches, F.col("day").alias("login_date"))
    exact = rollup.dau_of(rollup.day_bitmaps(rollup.user_days(logins)))
    near = rollup.within_error("user_cnt", "dau").alias("within_error")
    return exact.join(estimated, "login_date").select("login_date", "dau", near)


# --- facts by month, refreshed marts ----------------------------------------

LATE_FROM = "2000-01-01"
PRUNED_MONTH = "1998-03"


@query(ORACLES["mau"])
def mau_after_two_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mart refreshed by a second load, which brings the last months and late rows of earlier ones."""
    logins, root = inputs.order_logins(spark, sf_dir), scratch_path(spark, "logins")
    late = (F.col("login_date") >= LATE_FROM) | (F.pmod("user_id", F.lit(50)) == 0)
    for load, rows in (("first", logins.filter(~late)), ("second", logins.filter(late))):
        mart = facts.load_and_refresh(spark, rows, root, load, "login_date", activity.mau, "login_year_month")
    return tables.read_mart(spark, mart, SCHEMAS["mau"])


def _stored_orders(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    orders, path = inputs.orders(spark, sf_dir), scratch_path(spark, "orders")
    facts.store_load(orders, path, "order_date", "all")
    return path, orders


@query(f"""
SELECT o_custkey AS user_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS paid
FROM orders WHERE {month('o_orderdate')} = '{PRUNED_MONTH}' GROUP BY 1""")
def spend_of_a_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month of stored orders: only its folder is read."""
    path, orders = _stored_orders(spark, sf_dir)
    own = facts.read_facts(spark, path, orders.schema, PRUNED_MONTH, PRUNED_MONTH)
    return own.groupBy("user_id").agg(F.sum("payment_amount").alias("paid"))


@query(f"""
WITH {ORDER_USERS}, signups AS (SELECT {month('create_date')} AS m, count(*) AS n FROM users GROUP BY 1)
SELECT {month('o_orderdate')} AS month, count(*) AS orders FROM orders
WHERE {month('o_orderdate')} IN (SELECT m FROM signups WHERE n >= 10) GROUP BY 1""")
def orders_in_signup_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the months with ten signups or more: the table of months prunes the folders of the facts."""
    path, orders = _stored_orders(spark, sf_dir)
    signups = activity.nru(inputs.order_users(spark, sf_dir)).filter("user_cnt >= 10")
    months = signups.select(F.col("create_year_month").alias(facts.MONTH))
    return facts.facts_in(facts.read_facts(spark, path, orders.schema), months).groupBy("month").agg(F.count("*").alias("orders"))


# --- CSV --------------------------------------------------------------------


@query(ORACLES["au_by_signup_year"])
def csv_beside_other_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV folder that also holds files of another suffix, which are left out."""
    root = scratch_path(spark, "mixed")
    path = os.path.join(root, "au_by_signup_year.csv")
    tables.write_csv(metrics.au_by_signup_year(spark, sf_dir), path)
    notes = inputs.read(spark, sf_dir, "nation").select(F.concat_ws(",", "n_name", "n_nationkey", "n_regionkey"))
    notes.write.mode("append").text(path)
    return tables.load_table(spark, root, "au_by_signup_year")


@query(ORACLES["roas_by_campaign"])
def table_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that no list of schemas names, written as CSV with its schema and read back."""
    root = scratch_path(spark, "exchange")
    exchange.write_table(metrics.roas_by_campaign(spark, sf_dir), root, "roas_by_campaign")
    return exchange.read_table(spark, root, "roas_by_campaign")


ORDER_FAULTS = """CASE WHEN o_orderkey % 59 = 0 THEN 'order_date' WHEN o_orderkey % 53 = 0 THEN 'payment_amount'
       WHEN o_orderkey % 61 = 0 THEN 'user_id' ELSE 'none' END"""


@query(f"""
SELECT {ORDER_FAULTS} AS column_name, count(*) AS row_cnt,
       CAST(sum(CASE WHEN {ORDER_FAULTS} = 'none' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS paid
FROM orders GROUP BY 1""")
def quarantined_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A damaged copy of the orders: what parses is loaded, the rest is counted by the first column at fault."""
    root = scratch_path(spark, "damaged")
    key = F.col("o_orderkey")
    texts = inputs.read(spark, sf_dir, "orders").select(
        F.when(key % 59 == 0, "2001-13-01").otherwise(F.col("o_orderdate").cast("string")).alias("order_date"),
        F.lit("shop").alias("pickup_shop_name"),
        F.when(key % 53 == 0, "n/a").otherwise(F.format_string("%.2f", "o_totalprice")).alias("payment_amount"),
        F.when(key % 61 == 0, "nobody").otherwise(F.col("o_custkey").cast("string")).alias("user_id"),
    )
    tables.write_csv(texts, os.path.join(root, "orders.csv"))
    rejects = os.path.join(root, "rejects")
    loaded = quarantine.load_table_with_rejects(spark, root, "orders", rejects)
    kept = loaded.agg(F.lit("none").alias("column_name"), F.count("*").alias("row_cnt"), F.sum("payment_amount").alias("paid"))
    bad = spark.read.parquet(rejects).groupBy(F.col("column").alias("column_name")).agg(F.count("*").alias("row_cnt"))
    return kept.unionByName(bad, allowMissingColumns=True)
