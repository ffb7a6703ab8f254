"""Plans that must hold on large and skewed tables."""

import os
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tidemark.operators import activity, attribution, retention, sales, value
from tidemark.plans import star_inputs as inputs
from tidemark.plans.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@contextmanager
def conf(spark, **settings):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def large_tables(spark):
    """No side counts as small."""
    return conf(spark, spark__sql__autoBroadcastJoinThreshold="-1")


def splitting_skew(spark):
    return conf(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (\w+\([^)]*\)|\w+)", plan(df))


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))  # the metric queries; others may use Python
def test_no_cross_join_and_no_python(spark, name):
    with large_tables(spark):
        text = plan(entry_points.queries()[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "NestedLoop", "Python", "Pandas", "Arrow", "CollectLimit"):
        assert operator not in text


@needs_data
def test_scans_read_only_what_is_needed(spark):
    text = plan(activity.mau(inputs.order_logins(spark, SF_DIR)))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in text
    orders, regions = inputs.shop_orders(spark, SF_DIR), inputs.user_world_region(spark, SF_DIR)
    with conf(spark, spark__sql__maxMetadataStringLength="1000"):
        text = plan(sales.shop_region_sales_pivot(orders, regions, ["ASIA"], month="2001-07", shop="shop_id"))
    assert "GreaterThanOrEqual(o_orderdate,2001-07-01T00:00)" in text
    assert "LessThan(o_orderdate,2001-08-01T00:00)" in text
    with conf(spark, spark__sql__maxMetadataStringLength="1000"):
        text = plan(entry_points.queries()["mau_of_recent_months"](spark, SF_DIR))
    assert "GreaterThanOrEqual(o_orderdate,2000-10-01T00:00)" in text


def test_hot_shop_is_spread_over_its_payers(spark):
    orders = spark.range(10).select(
        (F.col("id") % 3).alias("pickup_shop_name"), F.lit(1).alias("payment_amount"), (F.col("id") % 5).alias("user_id")
    )
    first = exchanges(sales.shop_sales(orders))[-1]
    assert "pickup_shop_name" in first and "user_id" in first


def test_retention_shuffles_user_months_and_joins_on_the_user_only(spark):
    user = (F.col("id") % 5).alias("user_id")
    logins = spark.range(10).select(user, F.current_date().alias("login_date"))
    users = spark.range(10).select(user, F.current_date().alias("create_date"))
    with large_tables(spark):
        df = retention.nday_retention_monthly(logins, users)
        text = plan(df)
    assert text.count("SortMergeJoin") == 1
    # the user-months by user and month, both join sides by user; then one row per day
    assert len([e for e in exchanges(df) if "user_id" in e]) == 3


def skewed_signups(spark, n=60_000):
    """A third of the signups share the null id and one day."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 6).select(
        F.col("id").alias("user_id"),
        F.when(~hot, F.col("id").cast("string")).alias("attribute_id"),
        F.when(hot, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02")).cast("date").alias("create_date"),
    )


def test_id_shared_by_a_third_of_all_signups_is_split(spark):
    n = 60_000
    users = skewed_signups(spark, n)
    organic = users.select(F.col("create_date").alias("install_time"), "attribute_id")
    paid = organic.filter("attribute_id is null").withColumn("campaign", F.lit("c"))
    with splitting_skew(spark):
        df = attribution.signups_by_attribution(users, organic, paid)
        got = {(str(r.create_date), r.attribute_type): r.user_cnt for r in df.collect()}
        assert "skew=true" in plan(df)
    assert got == {
        ("2024-01-01", "organic"): n // 3,
        ("2024-01-01", "non_organic"): n // 3,
        ("2024-01-02", "organic"): n - n // 3,
    }


def test_order_with_a_third_of_all_lines_is_split(spark, tmp_path):
    n = 60_000
    order = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    lines = spark.range(0, n, 1, 6).select(
        order.alias("l_orderkey"),
        (F.col("id") % 7).alias("l_suppkey"),
        (F.col("id") % 1000).cast("double").alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("l_shipdate"),
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = spark.range(0, n, 1, 2).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 10).alias("o_custkey"),
        F.lit(1.0).alias("o_totalprice"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("o_orderdate"),
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    one_scan_task_per_file = conf(
        spark, spark__sql__files__maxPartitionBytes="100KB", spark__sql__files__openCostInBytes="100KB"
    )
    with splitting_skew(spark), one_scan_task_per_file:
        df = sales.shop_sales(inputs.shop_orders(spark, str(tmp_path)), shop="shop_id")
        got = {r.shop_id: float(r.sales) for r in df.collect()}
        assert "skew=true" in plan(df)
    assert got == pytest.approx({s: 0.9 * sum(i % 1000 for i in range(s, n, 7)) for s in range(7)})


def test_heavy_buyer_reaches_the_join_as_one_row_per_day(spark):
    """A user with a third of all orders is summed per day before the shuffle."""
    orders = spark.range(0, 30_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("user_id"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 2).cast("int")).alias("order_date"),
        F.lit(1).cast("decimal(18,2)").alias("payment_amount"),
    )
    spend = value.user_daily_spend(orders, "user_id", "order_date", "payment_amount")
    assert spend.filter("user_id = 0").count() == 2
    assert spend.agg(F.sum("paid")).first()[0] == 30_000


def test_login_rows_are_reduced_before_the_join(spark):
    """However often a user logs in, one row per month reaches the join with the signups."""
    logins = spark.range(0, 30_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("user_id"), F.lit("2024-01-05").cast("date").alias("login_date")
    )
    users = spark.range(0, 30_000).select(F.col("id").alias("user_id"), F.lit("2024-01-01").cast("date").alias("create_date"))
    assert activity.monthly_activity(logins).filter("user_id = 0").count() == 1
    assert activity.au_by_signup(logins, users).first().user_cnt == 20_001  # 20,000 others and the heavy one


@needs_data
@pytest.mark.parametrize("name", ["roas_by_attribute", "roas_by_campaign"])
def test_no_text_is_formatted_on_cost_rows(spark, name):
    """The filter on closed cohorts that Spark copies to the cost rows compares dates."""
    with large_tables(spark):
        text = plan(entry_points.queries()[name](spark, SF_DIR))
    for line in text.splitlines():
        assert not ("Filter" in line and "date_format" in line)
