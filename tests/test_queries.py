"""Every registered query against its SQL, on the smallest data set."""

import math
import os

import pytest

import __spark_entry__ as entry_points
import bench
from tidemark.plans.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def normal(rows):
    def cell(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_agrees_with_sql(spark, oracle, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    answer = oracle.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.select(*[f"`{c}`" for c in columns]).collect()) == normal(answer.fetchall())


def test_bench_runs_registered_queries():
    assert set(bench.HEADLINE) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).columns[0] == "campaign"
