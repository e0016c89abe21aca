import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, rolling, state
from tidemark.operators.ewm import ewm


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(3)
    days = pd.date_range("2020-01-01", periods=400)
    frame = pd.concat([pd.DataFrame({"series_id": s, "dt": days.date, "close": 100 + rng.standard_normal(400).cumsum()}) for s in "ab"])
    frame.loc[frame.index % 37 == 5, "close"] = None
    return frame, spark.createDataFrame(frame.astype({"close": object}).where(frame.notna(), None), "series_id string, dt date, close double")


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_matches_pandas(walk, adjust):
    frame, df = walk
    if not adjust:
        frame, df = frame.dropna(), df.dropna()
    got = ewm(df, F.col("close"), "e", 0.1, adjust).toPandas().sort_values(["series_id", "dt"])
    want = frame.groupby("series_id")["close"].transform(lambda s: s.ewm(alpha=0.1, adjust=adjust).mean())
    assert np.allclose(got["e"].astype(float), want, equal_nan=True)


def test_positions_match_a_loop(walk):
    frame, df = walk
    z = rolling.zscore(F.col("close"), 40, 20)
    got = state.hysteresis(df.withColumn("z", z), F.col("z"), 1.5, 0.5).toPandas().sort_values(["series_id", "dt"])
    for _, part in got.groupby("series_id"):
        held, want = 0, []
        for v in part["z"]:
            if pd.isna(v):
                want.append(0)
                continue
            held = (-1 if v > 1.5 else 1 if v < -1.5 else 0) if held == 0 else 0 if abs(v) < 0.5 else held
            want.append(held)
        assert want == part["position"].tolist()
    with pytest.raises(ValueError):
        state.hysteresis(df, F.col("close"), 1, 2)


def test_rank_and_fill_match_pandas(walk):
    frame, df = walk
    got = rolling.rolling_rank(df, "close", 30, "p", 30).select("series_id", "dt", "p", rolling.fill(F.col("close"), 2).alias("f")).toPandas().sort_values(["series_id", "dt"])
    want = frame.groupby("series_id")["close"].transform(lambda s: s.rolling(30).rank(pct=True))
    assert np.allclose(got["p"].astype(float), want, equal_nan=True)
    assert np.allclose(got["f"].astype(float), frame.groupby("series_id")["close"].transform(lambda s: s.ffill(limit=2)), equal_nan=True)


def test_asof_keeps_or_skips_nulls(spark):
    day = dt.date
    left = spark.createDataFrame([("a", day(2020, 1, 5)), ("a", day(2020, 1, 1)), ("b", day(2020, 1, 9))], "k string, dt date")
    right = spark.createDataFrame([("a", day(2020, 1, 2), 1.0), ("a", day(2020, 1, 4), None)], "k string, dt date, v double")
    rows = lambda skip: {(r.k, r.dt.day): r.v for r in align.asof(left, right, ["k"], "dt", "v", skip).collect()}
    assert rows(False) == {("a", 5): None, ("a", 1): None, ("b", 9): None}
    assert rows(True) == {("a", 5): 1.0, ("a", 1): None, ("b", 9): None}
