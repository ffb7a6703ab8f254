"""Loads by month, late rows, and the months of a mart that follow them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_scale import plan
from tidemark.operators import activity
from tidemark.sources import facts
from tidemark.sources.tables import read_mart

SCHEMA = "user_id long, login_date date"
MART = "login_year_month string, login_user_cnt long"


def logins(spark, *rows):
    return spark.createDataFrame([(u, d and dt.date.fromisoformat(d)) for u, d in rows], SCHEMA)


def loaded(spark, root, load, *rows):
    return facts.load_and_refresh(spark, logins(spark, *rows), str(root), load, "login_date", activity.mau, "login_year_month")


def counts(spark, mart):
    return {r.login_year_month: r.login_user_cnt for r in read_mart(spark, mart, MART).collect()}


def files(root, folder):
    return {str(p.relative_to(root)) for p in (root / folder).rglob("part-*")}


FIRST = [(1, "2022-05-03"), (2, "2022-05-04"), (1, "2022-06-01"), (3, "2022-07-09"), (9, None)]


def test_a_late_row_changes_its_month_only(spark, tmp_path):
    mart = loaded(spark, tmp_path, "a", *FIRST)
    assert counts(spark, mart) == {"2022-05": 2, "2022-06": 1, "2022-07": 1}
    before, stored = files(tmp_path, "mart"), files(tmp_path, "facts")
    loaded(spark, tmp_path, "b", (7, "2022-05-31"), (1, "2022-05-31"), (4, "2022-08-01"))
    assert counts(spark, mart) == {"2022-05": 3, "2022-06": 1, "2022-07": 1, "2022-08": 1}
    after = files(tmp_path, "mart")
    untouched = {f for f in before if "2022-05" not in f}
    assert untouched <= after and not (before - untouched) & after
    assert stored < files(tmp_path, "facts")


def test_a_load_stored_again_doubles_nothing(spark, tmp_path):
    make = lambda f: f.groupBy("month").agg(F.count("*").alias("n"))
    for _ in range(2):
        mart = facts.load_and_refresh(spark, logins(spark, *FIRST), str(tmp_path), "a", "login_date", make, "month")
    assert {r.month: r.n for r in spark.read.schema("n long, month string").parquet(mart).collect()} == {"2022-05": 2, "2022-06": 1, "2022-07": 1}


def test_empty_load(spark, tmp_path):
    mart = loaded(spark, tmp_path, "a", *FIRST)
    before = files(tmp_path, "mart")
    loaded(spark, tmp_path, "b")
    assert files(tmp_path, "mart") == before and len(counts(spark, mart)) == 3


@pytest.fixture
def stored(spark, tmp_path):
    rows = logins(spark, *FIRST, *[(u, f"2021-{m:02d}-11") for u in range(20) for m in range(1, 13)])
    facts.store_load(rows, str(tmp_path / "f"), "login_date", "a")
    return facts.read_facts(spark, str(tmp_path / "f"), rows.schema)


def test_a_range_of_months_reads_their_folders(spark, stored, tmp_path):
    some = facts.read_facts(spark, str(tmp_path / "f"), logins(spark).schema, "2021-11", "2022-05")
    assert some.count() == 42
    text = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in text and "month#" in text


def test_a_table_of_months_prunes_the_facts(spark, stored, tmp_path):
    months = facts.months_of(logins(spark, (5, "2021-03-04"), (6, "2022-06-30"), (6, None)), "login_date")
    assert sorted(r.month for r in months.collect()) == ["2021-03", "2022-06"]
    months.write.parquet(str(tmp_path / "months"))
    some = facts.facts_in(stored, spark.read.schema("month string").parquet(str(tmp_path / "months")))
    assert some.count() == 21
    assert "dynamicpruning" in some._jdf.queryExecution().toString().lower()
    assert "NestedLoop" not in plan(some)
