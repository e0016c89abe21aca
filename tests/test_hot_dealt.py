"""Rows of hot series are dealt by blocks once; places take no shuffle beside that by ranges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import hot, rolling, state
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["st1_hot_positions", "wn31_hot_running"])
def test_one_exchange_of_rows(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("most", [0, 200_000])
def test_kept_blocks_and_columns(spark, monkeypatch, most):
    monkeypatch.setattr(hot, "BROADCAST_ROWS", most, raising=False)
    x = F.sin(F.col("dt") / 3) * (F.col("dt") % 13)
    df = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.lit("a")).alias("series_id"), F.col("id").alias("dt"), F.lit(1).alias("wide")).withColumn("x", x)
    z = lambda w=None: {"z": rolling.zscore(F.col("x"), 12, 5, w)}
    blocks = hot.in_blocks(hot.placed(df.repartition(6), columns=["dt", "x"]), 12, [z], size=16, keep=True)
    got = hot.hysteresis(blocks, F.col("z"), 1.2, 0.4, size=16)
    assert sorted(got.columns) == ["__place", "dt", "position", "series_id", "x", "z"]
    want = state.hysteresis(df.withColumns(z()), F.col("z"), 1.2, 0.4)
    rows = lambda d: sorted(map(tuple, d.select("dt", "position", F.round("z", 9)).collect()))
    assert rows(got) == rows(want) and len({p for _, p, _ in rows(got)}) == 3
