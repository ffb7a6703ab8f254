"""CSV dialect, schemas and hand-off of metric tables."""

import os

import pytest

from tidemark.operators.sales import shop_sales_located
from tidemark.session import scratch_path
from tidemark.sources import tables
from tidemark.sources.schemas import SCHEMAS, STAR_SCHEMAS

GROWTH_ROW = ("가나구-다라동", "2031-04", 1, 58, None, None, None, "new")


def test_quoted_month_stays_text_and_bom_is_dropped(spark, tmp_path):
    text = '﻿"login_year_month","login_user_cnt"\n"2031-02",17\n"2031-03",29\n'
    (tmp_path / "mau.csv").write_text(text, encoding="utf-8")
    df = tables.load_table(spark, str(tmp_path), "mau")
    assert df.columns == ["login_year_month", "login_user_cnt"]
    assert sorted(tuple(r) for r in df.collect()) == [("2031-02", 17), ("2031-03", 29)]


def test_csv_round_trip_with_korean_text_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([GROWTH_ROW], SCHEMAS["mau_by_region_growth"])
    tables.write_csv(df, str(tmp_path / "mau_by_region_growth.csv"))
    parts = list((tmp_path / "mau_by_region_growth.csv").glob("*.csv"))
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbfregion,") for p in parts)
    back = tables.load_table(spark, str(tmp_path), "mau_by_region_growth")
    assert [tuple(r) for r in back.collect()] == [GROWTH_ROW]


def test_only_csv_files_of_a_folder_are_read_and_listed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("login_year_month,login_user_cnt\n2022-05,1\n")
    (tmp_path / "b.csv").write_text("login_year_month,login_user_cnt\n2022-06,2\n")
    (tmp_path / "notes.txt").write_text("nothing,here\n1,2\n")
    assert tables.read_csv(spark, str(tmp_path), SCHEMAS["mau"]).count() == 2
    listed = tables.list_files(spark, str(tmp_path)).collect()
    assert sorted(os.path.basename(r.path) for r in listed) == ["a.csv", "b.csv"]


def test_mart_is_split_by_month_and_read_by_month(spark):
    path = scratch_path(spark, "mart")
    df = spark.createDataFrame(
        [("2022-05", "2021", 1), ("2022-06", "2021", 2), ("2022-06", "2022", 3)], SCHEMAS["au_by_signup_year"]
    )
    tables.write_mart(df, path, month="login_year_month")
    back = tables.read_mart(spark, path, SCHEMAS["au_by_signup_year"])
    june = back.filter("login_year_month = '2022-06'")
    assert sorted(r.user_cnt for r in june.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(login_year_month" in june._jdf.queryExecution().toString()
    tables.write_mart(df, path + "-flat")
    assert spark.read.parquet(path + "-flat").count() == 3


def test_shop_table_without_bom_joins_finished_sums(spark, tmp_path):
    text = (
        "pickup_shop_name,region_1depth_name,region_2depth_name,region_3depth_name,h_code,x,y\n"
        "가게(일호점),가나시,다라구,마바동,9900000001,11.5,22.25\n"
    )
    (tmp_path / "pickup_shop.csv").write_text(text, encoding="utf-8")
    shops = tables.load_table(spark, str(tmp_path), "pickup_shop")
    sums = spark.createDataFrame([("가게(일호점)", 5, 2), ("가게(이호점)", 1, 1)], "pickup_shop_name string, sales int, pu int")
    got = {r.pickup_shop_name: (r.sales, r.h_code, r.x) for r in shop_sales_located(sums, shops).collect()}
    assert got == {"가게(일호점)": (5, 9900000001, 11.5), "가게(이호점)": (1, None, None)}


def test_scratch_folder_is_the_shared_one(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("schema", [*SCHEMAS.values(), *STAR_SCHEMAS.values()])
def test_schemas_parse(spark, schema):
    assert spark.createDataFrame([], schema).columns


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "login.csv").write_text("extra,user_id,login_date\nx,7,2022-05-01\n,8,\n")
    df = tables.load_table(spark, str(tmp_path), "login")
    assert [f.strip().split()[0] for f in SCHEMAS["login"].split(",")] == df.columns
    assert sorted((r.user_id, str(r.login_date)) for r in df.collect()) == [(7, "2022-05-01"), (8, "None")]


@pytest.mark.parametrize("row", ["2022-05-01,x", "not-a-date,1"])
def test_bad_values_raise(spark, tmp_path, row):
    (tmp_path / "login.csv").write_text(f"login_date,user_id\n2022-05-01,1\n{row}\n")
    with pytest.raises(Exception, match="is no"):
        tables.load_table(spark, str(tmp_path), "login").collect()


def test_missing_column_raises(spark, tmp_path):
    (tmp_path / "login.csv").write_text("login_date,user\n2022-05-01,1\n")
    with pytest.raises(ValueError, match="user_id"):
        tables.load_table(spark, str(tmp_path), "login")
