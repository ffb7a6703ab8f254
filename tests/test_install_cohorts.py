"""Cohorts whose members overlap, and the end of observation that is found in the orders."""

import datetime as dt
import os
from contextlib import closing

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tests.test_queries import TABLES, normal
from tests.test_scale import SF_DIR, needs_data, plan, skewed_signups, splitting_skew
from tidemark.functions.timekeys import end_of_last_full_month
from tidemark.operators import value

duckdb = pytest.importorskip("duckdb")
VALUE_QUERIES = (
    "cohort_ltv", "organic_ltv", "ltv_head", "roas_by_attribute", "roas_by_campaign",
    "cohort_ltv_by_install", "roas_by_install_campaign",
)


def agrees(spark, sf_dir, name):
    with closing(duckdb.connect()) as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        answer = con.execute(entry_points.oracle_sql()[name])
        columns = [c[0] for c in answer.description]
        want = normal(answer.fetchall())
    got = entry_points.queries()[name](spark, sf_dir).select(*columns).collect()
    assert normal(got) == want
    return got


@pytest.fixture(scope="module")
def later(tmp_path_factory):
    """The tables with two more years of orders, the last month of them whole."""
    folder = str(tmp_path_factory.mktemp("later"))
    for t in TABLES:
        if t != "orders":
            os.symlink(f"{SF_DIR}/{t}.parquet", f"{folder}/{t}.parquet")
    moved = "SELECT * REPLACE (o_orderkey + 1000000 AS o_orderkey, o_orderdate + INTERVAL 25 MONTH AS o_orderdate) FROM o"
    last = "SELECT * REPLACE (-1 AS o_orderkey, TIMESTAMP '2003-10-31 23:00:00' AS o_orderdate) FROM o LIMIT 1"
    with closing(duckdb.connect()) as con:
        con.execute(f"CREATE VIEW o AS SELECT * FROM '{SF_DIR}/orders.parquet'")
        con.execute(f"COPY (SELECT * FROM o UNION ALL {moved} UNION ALL ({last})) TO '{folder}/orders.parquet' (FORMAT parquet)")
    return folder


@needs_data
@pytest.mark.parametrize("name", VALUE_QUERIES)
def test_tables_with_later_orders(spark, later, name):
    got = agrees(spark, later, name)
    if name == "cohort_ltv":  # orders up to the last day of October 2003
        months = [int(r.create_year_month[:4]) * 12 + int(r.create_year_month[5:]) + r.ltv_period for r in got]
        assert max(months) == 2003 * 12 + 10


@needs_data
def test_end_of_observation_is_part_of_the_plan(spark):
    text = plan(entry_points.queries()["cohort_ltv"](spark, SF_DIR))
    assert "Subquery" in text and "2001-07-31" not in text


def test_last_full_month(spark):
    days = ["2024-02-29", "2024-02-28", "2024-03-01", "2023-12-31", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select("d", end_of_last_full_month("d").alias("e"))
    assert {r.d: str(r.e) for r in df.collect()} == {
        "2024-02-29": "2024-02-29",
        "2024-02-28": "2024-01-31",
        "2024-03-01": "2024-02-29",
        "2023-12-31": "2023-12-31",
        None: "None",
    }


@needs_data
def test_sizes_are_the_signup_counts(spark):
    queries = entry_points.queries()
    signups = {(r.create_year_month, r.attribute_type): r.user_cnt for r in queries["signups_monthly_with_all"](spark, SF_DIR).collect()}
    ltv = queries["cohort_ltv_by_install"](spark, SF_DIR).filter("ltv_period = 0").collect()
    assert {(r.create_year_month, r.attribute_type): r.user_cnt for r in ltv} == signups
    kinds = {t: n for (_, t), n in signups.items()}
    assert max(kinds["organic"], kinds["non_organic"]) <= kinds["all"] < kinds["organic"] + kinds["non_organic"]


def no_orders(spark):
    return spark.createDataFrame([], "user_id long, order_date timestamp_ntz, payment_amount decimal(18,2)")


def test_no_orders_no_cohorts(spark):
    users = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1))], "user_id long, attribute_id string, create_date date")
    installs = users.select(F.col("create_date").alias("install_time"), "attribute_id")
    assert value.cohort_ltv_by_install(users, installs, installs, no_orders(spark)).collect() == []
    given = value.cohort_ltv_by_install(users, installs, installs, no_orders(spark), obs_end=dt.date(2024, 2, 29))
    assert sorted((r.attribute_type, r.ltv_period, r.user_cnt) for r in given.collect()) == [
        (t, n, 1) for t in ("all", "non_organic", "organic") for n in (0, 1)
    ]


def test_third_of_the_signups_on_one_id(spark):
    """The match is split at the null id, each user counts once in `all`, and spend meets both cohorts."""
    n = 60_000
    users = skewed_signups(spark, n)
    organic = users.select(F.col("create_date").alias("install_time"), "attribute_id")
    paid = organic.filter("attribute_id is null or attribute_id < '3'").withColumn("campaign", F.lit("c"))
    orders = spark.range(0, n, 1, 6).select(
        F.col("id").alias("user_id"), F.lit("2024-01-31").cast("timestamp_ntz").alias("order_date"), F.lit(1).cast("decimal(18,2)").alias("payment_amount")
    )
    with splitting_skew(spark):
        df = value.cohort_ltv_by_install(users, organic, paid, orders)
        got = {r.attribute_type: (r.user_cnt, int(r.revenue)) for r in df.collect()}
        assert "skew=true" in plan(df)
    few = sum(i % 3 != 0 and str(i) < "3" for i in range(n))
    assert got == {"organic": (n, n), "all": (n, n), "non_organic": (n // 3 + few, n // 3 + few)}
    cost = spark.createDataFrame([(dt.date(2024, 1, 9), "c", 7)], "aggregate_date date, campaign string, cost int")
    cost = cost.withColumn("cost", F.col("cost").cast("decimal(18,2)"))
    roas = value.roas_by_install_campaign(users, organic, paid, orders, cost, horizon=0).collect()
    assert [(r.campaign, r.user_cnt, r.roas) for r in roas] == [("c", few, round(few / 7, 4))]  # null ids lead to no campaign
