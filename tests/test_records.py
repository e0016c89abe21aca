"""Readers, sinks and trade logs on small rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.sources import readers, sinks


def test_csv_reads_required_and_optional_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,close,extra\n2024-01-02,1.5,x\nbad,n/a,y\n")
    got = readers.csv(spark, str(tmp_path / "a.csv"), {"day": "date", "close": "double"}, {"volume": "double"})
    assert got.columns == ["day", "close", "volume"]
    assert [(str(r.day), r.close, r.volume) for r in got.collect()] == [("2024-01-02", 1.5, None), ("None", None, None)]
    with pytest.raises(ValueError, match="missing columns: open"):
        readers.csv(spark, str(tmp_path / "a.csv"), {"open": "double"})


def test_json_documents_become_rows(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"date": "2024-01-02", "entries": [{"seq": 1, "raw": "a"}, {"seq": 2, "raw": None}]}))
    got = readers.json_documents(spark, str(tmp_path / "d.json"), "date string, entries array<struct<seq:int,raw:string>>", "entries")
    assert [tuple(r) for r in got.orderBy("seq").collect()] == [("2024-01-02", 1, "a"), ("2024-01-02", 2, None)]


def test_report_drops_rows_without_a_date(spark):
    df = spark.createDataFrame([("01/31/2024", "5"), ("31.1.2024", "6"), (None, "7"), ("02/01/2024", "x")], "d string, v string")
    got = readers.report(df, {"d": "dt", "v": "value", "gone": "other"}, "d")
    assert [(str(r.dt), r.value) for r in got.orderBy("dt").collect()] == [("2024-01-31", 5.0), ("2024-02-01", None)]


def test_keyed_header_and_priority(spark):
    df = spark.createDataFrame([(1, 2.0)], "`Key No.` int, `Debit Balance` double")
    assert readers.keyed_header(df, {"k": ("key",), "v": ("debit", "balance")}).first().asDict() == {"k": 1, "v": 2.0}
    with pytest.raises(ValueError, match="no heading"):
        readers.keyed_header(df, {"v": ("credit",)})
    a, b = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double"), spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0)], "k int, v double")
    assert sorted(tuple(r) for r in readers.by_priority([a, b], ["k"], "v").collect()) == [(1, 1.0, 0), (2, 8.0, 1), (3, 7.0, 1)]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02", "eur", 1, "b"), ("2024-01-02", None, 2, "c"), ("2024-01-03", "eur", 1, "a")], "day string, tag string, seq int, raw string")
    sinks.parquet(df, str(tmp_path / "p"), ["day"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    sinks.csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == df.columns
    sinks.json_snapshot(df, str(tmp_path / "j"), {"asof": "2024-01-03"}, {"x": "a number"})
    head = spark.read.json(str(tmp_path / "j/header")).collect()
    assert [(r.metadata.asof, r.legend.x, r.records) for r in head] == [("2024-01-03", "a number", df.count())]
    assert spark.read.json(str(tmp_path / "j/records")).count() == df.count()
    sinks.day_report(df, str(tmp_path / "r"), "day", "tag", "seq", "raw")
    text = "".join(p.read_text() for p in (tmp_path / "r" / "day=2024-01-02").glob("*.txt"))
    assert text.splitlines() == ["## EUR", "- b", "## GENERAL", "- c"]


def test_episodes_close_or_stay_open(spark):
    xs = [80, 70, 50, 76, 40, 90, 91]
    rows = [("s", i, float(10 + i), float(x)) for i, x in enumerate(xs)] + [("n", 0, 1.0, None)]
    df = spark.createDataFrame(rows, "series_id string, dt int, close double, x double")
    got = state.episodes(df, F.col("x"), 75, 55).orderBy("entry_dt").collect()
    assert [(r.entry_dt, r.exit_dt, r.still_open, r.duration) for r in got] == [(0, 2, False, 2), (3, 4, False, 1), (5, 6, True, 1)]
