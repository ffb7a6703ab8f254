"""Tables read back row for row, and rows that do not parse."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tidemark.sources import exchange, quarantine, tables
from tidemark.sources.schemas import SCHEMAS

ODD = [
    "", None, " pad ", '"', 'a"b', "a,b", "a\nb", "a\r\nb", "\\", "\\n", "\\\\n", "\\e", "\\\\e", "n\\", "가게", "﻿x", "2022-05", "0012", "null", "#x", "\t",
]


def test_any_table_is_read_back(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (
            text,
            rng.choice([None, 0, -(2**63), 2**63 - 1]),
            rng.choice([None, 0.1, 1e-300, float("inf"), -0.0]),
            rng.choice([None, Decimal("0.10"), Decimal("-99999999999999999999.99")]),
            rng.choice([None, dt.date(2022, 5, 1), dt.date(1, 1, 1)]),
            rng.choice([None, dt.datetime(2022, 5, 1, 23, 59, 59, 123456)]),
            rng.choice([None, True, False]),
            rng.choice(ODD),
        )
        for text in ODD
        for _ in range(4)
    ]
    schema = "`the key` string, n bigint, d double, m decimal(38,2), day date, ts timestamp_ntz, b boolean, s string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    exchange.write_table(df, str(tmp_path), "odd")
    back = exchange.read_table(spark, str(tmp_path), "odd")
    assert back.schema == df.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    files = [p.read_text(encoding="utf-8") for p in (tmp_path / "odd.csv").glob("*.csv")]
    assert all(text.startswith('\ufeff"the key","n",') for text in files)
    assert any('\n"2022-05",' in text for text in files)


def test_one_column_of_nulls_and_empty_texts(spark, tmp_path):
    df = spark.createDataFrame([("",), (None,), (None,), (" ",)], "a string")
    exchange.write_table(df, str(tmp_path), "one")
    assert sorted(map(str, exchange.read_table(spark, str(tmp_path), "one").collect())) == sorted(map(str, df.collect()))


def test_plain_table_looks_as_expected(spark, tmp_path):
    df = spark.createDataFrame([("2022-05", 41, None)], "ym string, n int, r double").coalesce(1)
    exchange.write_table(df, str(tmp_path), "t")
    (part,) = (tmp_path / "t.csv").glob("*.csv")
    assert part.read_text(encoding="utf-8-sig") == '"ym","n","r"\n"2022-05",41,\n'


def test_empty_table_keeps_its_schema(spark, tmp_path):
    df = spark.createDataFrame([], "ym string, n int")
    exchange.write_table(df, str(tmp_path), "none")
    back = exchange.read_table(spark, str(tmp_path), "none")
    assert back.schema == df.schema and back.collect() == []


def test_nested_columns_are_refused(spark, tmp_path):
    for kind in ("array<int>", "binary"):
        with pytest.raises(ValueError, match="holds no x"):
            exchange.write_table(spark.createDataFrame([], f"a int, x {kind}"), str(tmp_path), "x")


def test_changed_cell_raises(spark, tmp_path):
    exchange.write_table(spark.createDataFrame([("2022-05", 1)], "ym string, n int"), str(tmp_path), "t")
    for p in (tmp_path / "t.csv").glob("*.csv"):
        p.write_text(p.read_text(encoding="utf-8").replace(",1", ",x"), encoding="utf-8")
    for p in (tmp_path / "t.csv").glob(".*.crc"):
        p.unlink()
    with pytest.raises(Exception, match="n is no int"):
        exchange.read_table(spark, str(tmp_path), "t").collect()


LOGIN = SCHEMAS["login"]


def test_rows_that_do_not_parse_are_listed(spark, tmp_path):
    good, lines = 0, ["﻿extra,user_id,login_date"]
    rng, want = random.Random(1), []
    for i in range(2, 4000):
        kind = rng.randrange(12)
        line = {0: f"x,{i},2022-13-01", 1: "x,seven,2022-05-01", 2: f"x,{i}", 3: f"x,{i},2022-05-01,more", 4: "", 5: "x,no,never"}.get(
            kind, f'"a,""b",{i},2022-05-01' if kind < 11 else f",{i},"
        )
        lines.append(line)
        good += kind > 5
        if kind in (0, 1, 2, 3, 5):
            column, value = {0: ("login_date", "2022-13-01"), 1: ("user_id", "seven"), 5: ("login_date", "never")}.get(kind, ("*", line))
            want.append((i, column, value, line))
    lines.append("extra,user_id,login_date")  # a header within the file
    want.append((len(lines), "*", lines[-1], lines[-1]))
    (tmp_path / "login.csv").mkdir()
    (tmp_path / "login.csv" / "a.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "login.csv" / "b.csv").write_text("extra,user_id,login_date\nx,y,z\nx,1,\n", encoding="utf-8")
    (tmp_path / "login.csv" / "c.bak").write_text("no table", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20KB")  # several blocks of a file
    try:
        rows = quarantine.load_table_with_rejects(spark, str(tmp_path), "login", str(tmp_path / "rejects"))
        assert rows.columns == ["login_date", "user_id"] and rows.count() == good + 1
        got = spark.read.parquet(str(tmp_path / "rejects")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    mine = sorted((r.line, r.column, r.value, r.record) for r in got if r.file.endswith("a.csv"))
    assert mine == sorted(want)
    assert [(r.line, r.column, r.value) for r in got if r.file.endswith("b.csv")] == [(2, "login_date", "z")]
    assert all("c.bak" not in r.file for r in got)
    assert rows.filter("login_date is null").count() == sum(x.endswith(",") for x in lines) + 1


def test_raising_stays_the_default(spark, tmp_path):
    (tmp_path / "login.csv").write_text("login_date,user_id\nnever,1\n")
    with pytest.raises(Exception, match="is no"):
        tables.load_table(spark, str(tmp_path), "login").collect()
    rows, rejects = quarantine.read_with_rejects(spark, str(tmp_path / "login.csv"), LOGIN)
    assert rows.collect() == [] and rejects.count() == 1
    with pytest.raises(ValueError, match="no column"):
        quarantine.read_with_rejects(spark, str(tmp_path / "login.csv"), SCHEMAS["users"])


def test_texts_only_and_a_header_alone(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\na,b\nx,\n")
    rows, rejects = quarantine.read_with_rejects(spark, str(tmp_path / "t.csv"), "a string, b string")
    assert [tuple(r) for r in rows.collect()] == [("x", None)]
    assert [(r.line, r.column) for r in rejects.collect()] == [(2, "*")]
    (tmp_path / "h.csv").write_text("a,b\n")
    rows, rejects = quarantine.read_with_rejects(spark, str(tmp_path / "h.csv"), "a string, b string")
    assert rows.collect() == rejects.collect() == []
