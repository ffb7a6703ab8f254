"""The input tables of the metrics, taken from a star schema with an event log.

Orders stand for logins as well as for sales, the first order for the signup,
and two event types for the two kinds of install.  Amounts have two decimals in
the source and are kept as exact decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.activity import user_regions
from tidemark.sources.schemas import STAR_SCHEMAS

#: The orders lie as many years before the events as this; moved, they are what the events' users spent later.
LATER_YEARS = 29
ORGANIC_SEGMENT = "HOUSEHOLD"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its declared columns, so that no job has to look into the files for them."""
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(c: str) -> str:
    """A non-negative double with two decimals as a whole number of hundredths."""
    return f"floor({c} * 100 + 0.5)"


def _amount(units: str, digits: int) -> Column:
    """Whole units of 10^-digits as an exact decimal.

    Casting a double to decimal goes through its text, row by row; this does not.
    """
    return F.expr(f"CAST(CAST({units} AS DECIMAL(18,0)) * {10**-digits:.{digits}f}BD AS DECIMAL(18,{digits}))")


def _payment() -> Column:
    """Price after discount."""
    return _amount(f"{_hundredths('l_extendedprice')} * (100 - {_hundredths('l_discount')})", 4)


def _discount() -> Column:
    """The discount as an amount."""
    return _amount(f"{_hundredths('l_extendedprice')} * {_hundredths('l_discount')}", 4)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))


def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; the supplier is the shop.

    The shop is left as a key here.  Its name is looked up on the finished
    sums, so the line items are not shuffled once more for it.
    """
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("order_date"),
    )
    payment = _payment().alias("payment_amount")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("shop_id"), payment)
    return lines.join(orders, "l_orderkey").select("order_date", "shop_id", "payment_amount", "user_id")


def shop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each shop key."""
    suppliers = read(spark, sf_dir, "supplier")
    return suppliers.select(F.col("s_suppkey").alias("shop_id"), F.col("s_name").alias("pickup_shop_name"))


def shop_region_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like :func:`shop_orders`, with the supplier's world region as the name of the shop."""
    shops = read(spark, sf_dir, "supplier").join(_regions(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    names = shops.select(F.col("s_suppkey").alias("shop_id"), F.col("r_name").alias("pickup_shop_name"))
    return shop_orders(spark, sf_dir).join(names, "shop_id").drop("shop_id")


def shop_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each supplier is."""
    shops = read(spark, sf_dir, "supplier").join(_regions(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    return shops.select(
        F.col("s_name").alias("pickup_shop_name"),
        F.col("r_name").alias("region_1depth_name"),
        F.col("n_name").alias("region_2depth_name"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its total."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("order_date"),
        _amount(_hundredths("o_totalprice"), 2).alias("payment_amount"),
        F.col("o_custkey").alias("user_id"),
    )


def later_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders moved to the years from the first events on."""
    moved = F.col("order_date") + F.make_ym_interval(F.lit(LATER_YEARS))
    return orders(spark, sf_dir).withColumn("order_date", moved)


def order_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A login for each order: 80 months of activity."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("login_date")
    )


def event_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A login for each event: 30 days of activity."""
    return read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("login_date"))


def order_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ordered; the first order is the signup."""
    firsts = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"))
    return firsts.agg(F.to_date(F.min("o_orderdate")).alias("create_date"))


def segment_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups with the market segment as campaign; one segment counts as organic."""
    segments = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("campaign"),
        F.when(F.col("c_mktsegment") == ORGANIC_SEGMENT, "organic").otherwise("non_organic").alias("attribute_type"),
    )
    return order_users(spark, sf_dir).join(segments, "user_id")


def event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups from the event log; the first one counts."""
    signups = read(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    firsts = signups.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("create_date"))
    return firsts.withColumn("attribute_id", F.col("user_id").cast("string"))


def organic_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installs without a campaign column."""
    views = read(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return views.select(F.col("ts").alias("install_time"), F.col("user_id").cast("string").alias("attribute_id"))


def non_organic_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = read(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return clicks.select(
        F.col("ts").alias("install_time"),
        F.col("user_id").cast("string").alias("attribute_id"),
        F.get_json_object("props", "$.k").alias("campaign"),
    )


def user_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's ``region-nation``."""
    customers = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id")
    placed = customers.join(_regions(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return user_regions(placed, "r_name", "n_name")


def user_world_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's region alone: a short list, as a pivot wants."""
    customers = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id")
    placed = customers.join(_regions(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return user_regions(placed, "r_name")


def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost rows by ship date."""
    return read(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("aggregate_date"), _discount().alias("cost")
    )


def campaign_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost rows by ship date and the segment of the ordering customer."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("aggregate_date"), _discount().alias("cost"), "l_orderkey"
    )
    owners = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    segments = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("campaign")
    )
    owned = owners.join(segments, "o_custkey").select("l_orderkey", "campaign")
    return lines.join(owned, "l_orderkey").select("aggregate_date", "campaign", "cost")


def click_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cost row for each click of a campaign."""
    clicks = read(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return clicks.select(
        F.to_date("ts").alias("aggregate_date"),
        F.get_json_object("props", "$.k").alias("campaign"),
        _amount(_hundredths("value"), 2).alias("cost"),
    )
