"""The export: complete, read back row for row, from one reading of the raw facts, leaving nothing behind."""

import datetime as dt
import os
from decimal import Decimal
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tests.test_exports import SETTINGS, raw_rows
from tests.test_scale import plan
from tidemark.plans import exports
from tidemark.session import Scratch, scratch_path
from tidemark.sources import exchange, tables
from tidemark.sources.schemas import SCHEMAS

SHOPS = [("shop a", "do", "si", "dong", 1, 37.5, 127.25), ("shop c", "do", None, "dong", 2, 0.0, 0.0)]
FULL = exports.Settings(
    ref_month="2022-09",
    regions=["north", "south"],
    series_start="2022-06",
    cohorts_from="2022-07",
    periods=[(dt.date(2022, 6, 1), dt.date(2022, 6, 9), "opening"), (dt.date(2022, 10, 1), None, "last")],
)


def written_raw(spark, folder, **changed):
    rows = raw_rows() | {"pickup_shop": SHOPS} | changed
    for name, own in rows.items():
        tables.write_csv(spark.createDataFrame(own, SCHEMAS[name]), f"{folder}/{name}.csv")
    return str(folder)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    late = [(dt.datetime(2022, 11, 3, 9), "shop b", Decimal("7.00"), 1), (None, "shop a", Decimal("1.50"), 2)]
    return written_raw(spark, tmp_path_factory.mktemp("raw"), orders=raw_rows()["orders"] + late)


@pytest.fixture(scope="module")
def made(spark, root):
    return exports.metric_tables(spark, exports.load_raw_tables(spark, root, shops=True), FULL)


def test_the_reference_tables_are_all_there(made):
    assert {
        "dau", "cohort_return_rate_long", "nday_retention_daily_long", "nday_retention_monthly_long", "period_annotated_dau",
        "orders_profile", "shop_sales_located", "shop_region_sales_filled",
    } <= set(made)
    assert len(made) == 30


def test_every_table_is_read_back_row_for_row(spark, made, tmp_path):
    exports.write_csv_tables(made, str(tmp_path))
    for name, table in made.items():
        back = exchange.read_table(spark, str(tmp_path), name)
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in table.schema], name
        assert sorted(map(str, back.collect())) == sorted(map(str, table.collect())), name


def test_raw_facts_are_read_once(made, root):
    for name, table in made.items():
        text = table._jdf.queryExecution().toString()
        assert f"{root}/orders.csv" not in text and f"{root}/login.csv" not in text, name
        assert f"{root}/non_organic_install.csv" not in text, name


def test_one_month_reads_its_folder(made):
    text = made["shop_region_sales"]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in text and "month" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_spend_is_not_shuffled_again(spark, made):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Scratch(spark):
            raw = exports.load_raw_tables(spark, _root_of(made))
            text = plan(exports.metric_tables(spark, raw, SETTINGS)["roas_by_campaign"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Exchange hashpartitioning(user_id") <= 1, text  # of the members at most
    assert "Bucketed: true" in text


def _root_of(made):
    text = made["daily_cost"]._jdf.queryExecution().toString()
    return urlparse(text.split("InMemoryFileIndex(1 paths)[")[1].split("]")[0]).path.rsplit("/", 1)[0]


def test_sums_of_the_sales(made):
    total = sum(p for _, _, p, _ in raw_rows()["orders"]) + Decimal("8.50")
    assert made["shop_sales"].agg(F.sum("sales")).first()[0] == total
    assert made["shop_sales_monthly"].filter("order_year_month = '2022-11'").count() == 1
    assert made["orders_profile"].first().row_cnt == len(raw_rows()["orders"]) + 2


def test_end_of_observation_is_found_in_the_orders(made):
    ltv = made["cohort_ltv"].filter("attribute_type = 'all' AND create_year_month = '2022-05'").collect()
    assert max(r.ltv_period for r in ltv) == 5  # up to October: November has three days


def test_nothing_after_the_last_day_counts(spark, tmp_path):
    later = [(dt.date(2022, 11, 2), 1)]
    users = [*raw_rows()["users"], (99, dt.date(2022, 11, 4), "z")]
    folder = written_raw(spark, tmp_path, login=raw_rows()["login"] + later, users=users)
    with Scratch(spark):
        found = exports.metric_tables(spark, exports.load_raw_tables(spark, folder), SETTINGS)
        months = {
            name: {r[0] for r in found[name].select(c).distinct().collect()}
            for name, c in (("mau", "login_year_month"), ("nru", "create_year_month"), ("nday_retention_monthly", "login_year_month"),
                            ("mau_by_region_growth", "login_year_month"), ("cohort_return_rate", "login_year_month"))
        }
    assert all(max(own) == "2022-10" for own in months.values()), months


def test_scratch_tables_are_gone(spark, root, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    before, known = set(os.listdir(shared)), {t.name for t in spark.catalog.listTables()}
    names = exports.export(spark, root, str(tmp_path / "out"), SETTINGS)
    assert set(os.listdir(shared)) == before and {t.name for t in spark.catalog.listTables()} == known
    assert exchange.read_table(spark, str(tmp_path / "out"), "mau").count() > 0 and "mau" in names


def test_nested_scratch(spark):
    with Scratch(spark) as outer:
        a = scratch_path(spark, "a")
        with Scratch(spark) as inner:
            b = scratch_path(spark, "b")
            spark.range(1).write.parquet(b)
        assert not os.path.exists(b) and outer.paths == [a] and inner.paths == [b]


def test_buckets_follow_the_size(spark):
    assert tables.buckets_for(spark.range(10)) == 4  # as many as a shuffle has partitions
    assert tables.buckets_for(spark.range(1 << 26), megabytes=64) == 8
