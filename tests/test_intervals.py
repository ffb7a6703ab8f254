"""The interval join against a search through all pairs, at open and crossing ends, and with a hot bucket."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_scale import large_tables, plan, splitting_skew
from tidemark.operators import annotate, intervals

AT, FIRST, LAST = "at", "first", "last"


def joined(spark, points, spans, how="left", width=intervals.WIDTH):
    p = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "id long, at long")
    s = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "span long, first long, last long")
    got = intervals.interval_join(p, s, AT, FIRST, LAST, how, width)
    assert got.columns == ["id", "at", "span", "first", "last"]
    return sorted(((r.id, r.span) for r in got.collect()), key=str)


def searched(points, spans, how="left"):
    found = []
    for i, x in enumerate(points):
        own = [
            (i, k) for k, (a, b) in enumerate(spans)
            if x is not None and (a is None or a <= x) and (b is None or x <= b)
        ]
        found += own or ([(i, None)] if how == "left" else [])
    return sorted(found, key=str)


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_random_intervals_against_search(spark, width, how):
    rng = random.Random(width)
    some = lambda n: None if rng.random() < n else rng.randint(-40, 40)
    points = [some(0.1) for _ in range(120)]
    spans = [(some(0.2), some(0.2)) for _ in range(40)] + [(-10_000, 10_000), (30, 20), (41, 90), (5, 5), (None, None)]
    assert joined(spark, points, spans, how, width) == searched(points, spans, how)


def test_empty_sides(spark):
    assert joined(spark, [], [(1, 2), (None, None)]) == []
    assert joined(spark, [None, None], [(None, None)]) == [(0, None), (1, None)]
    assert joined(spark, [3], []) == [(0, None)]
    with pytest.raises(ValueError):
        joined(spark, [3], [], "full")


def test_an_interval_is_written_only_where_points_are(spark):
    p = spark.createDataFrame([(1,), (40,)], "at long")
    s = spark.createDataFrame([(None, 2**40), (-(2**40), None)], "first long, last long")
    assert intervals.interval_join(p, s, AT, FIRST, LAST).count() == 4


def test_positions(spark):
    row = spark.sql("SELECT date'1970-01-03' d, '2022-05' m, 'M7' a, 'M+12' b, 'all' c, CAST(NULL AS STRING) n")
    got = row.select(
        intervals.day_position("d"), intervals.month_position("m"), *(intervals.index_position(c) for c in "abcn")
    ).first()
    assert tuple(got) == (2, 2022 * 12 + 5, 7, 12, None, None)


def test_periods_by_month_and_index(spark, rows):
    months = spark.createDataFrame([("2022-05", 1), ("2022-07", 2), (None, 3)], "ym string, n int")
    periods = annotate.period_table(spark, [(None, "2022-05", "early"), ("2022-05", "2022-06", "mid")], "month")
    got = {(r["n"], r["note"]) for r in rows(annotate.annotate_periods(months, periods, "ym", "month"))}
    assert got == {(1, "early"), (1, "mid"), (2, None), (3, None)}
    index = spark.createDataFrame([("M0",), ("M3",), ("M9",)], "time_order string")
    periods = annotate.period_table(spark, [("M+0", "M+2", "trial"), ("M+3", None, "later")], "index")
    noted = annotate.annotate_periods(index, periods, "time_order", "index")
    assert noted.columns == ["time_order", "note"]
    assert {tuple(r) for r in noted.collect()} == {("M0", "trial"), ("M3", "later"), ("M9", "later")}


def test_open_period_of_days(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 5, 9)], "d date")
    periods = annotate.period_table(spark, [(dt.date(2024, 1, 5), None, "open")])
    got = annotate.annotate_periods(days, periods, "d")
    assert {(r.d.day, r.note) for r in got.collect()} == {(1, None), (5, "open"), (9, "open")}


def test_day_with_a_third_of_all_points_is_split(spark):
    n = 60_000
    points = spark.range(0, n, 1, 6).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("at"))
    spans = spark.range(0, n, 50).select(F.col("id").alias("first"), (F.col("id") + 9).alias("last"))
    with splitting_skew(spark):
        df = intervals.interval_join(points, spans, AT, FIRST, LAST, "inner")
        assert df.count() == n // 3 + sum(i % 3 != 0 and i % 50 < 10 for i in range(n))
    with splitting_skew(spark):
        df = intervals.interval_join(points, spans, AT, FIRST, LAST)
        assert df.collect() and "skew=true" in plan(df)


def test_no_nested_loop(spark):
    points, spans = spark.range(5).withColumnRenamed("id", "at"), spark.range(5).selectExpr("id first", "id + 1 last")
    with large_tables(spark):
        text = plan(intervals.interval_join(points, spans, AT, FIRST, LAST))
    assert "NestedLoop" not in text and "Cartesian" not in text and text.count("SortMergeJoin") == 1
