"""Capped carries, folds, dedupe, refits and fills against loops and pandas."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, events, rolling
from tidemark.operators.ewm import Mean, ewms, recurrences

day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_cap_counts_dates_of_both_sides_once(spark):
    left = spark.createDataFrame([("k", day(n), i) for n in (0, 2, 4, 5, 6, 9) for i in range(3)], "k string, dt date, i int")
    right = spark.createDataFrame([("k", day(0), 1.0), ("k", day(3), 2.0), ("k", day(4), None), ("k", day(20), 9.0)], "k string, dt date, v double")
    dates = sorted({day(n) for n in (0, 2, 3, 4, 5, 6, 9, 20)})
    for cap in (0, 1, 2, 3):
        s = pd.Series({day(0): 1.0, day(3): 2.0}).reindex(dates)
        want = s.ffill(limit=cap) if cap else s
        got = align.asof(left, right, ["k"], "dt", "v", skip_null=True, cap=cap).collect()
        assert len(got) == 18 and all((r.v if r.v is not None else -1) == (want[r.dt] if want[r.dt] == want[r.dt] else -1) for r in got)


def test_first_folds_train_on_fewer_rows(spark):
    rows = spark.createDataFrame([("a", day(n), float(n)) for n in range(40)] + [("b", day(0), 1.0)], "series_id string, dt date, x double")
    got = align.folds(rows, train=15, test=6, step=4, least=8).collect()
    want = set()
    for fold, pos in enumerate(range(8, 40 - 6 + 1, 4)):
        want |= {(fold, n, "train") for n in range(max(0, pos - 15), pos)} | {(fold, n, "test") for n in range(pos, pos + 6)}
    assert {(r.fold, r.rn, r.part) for r in got} == want and {r.series_id for r in got} == {"a"}


def test_dedupe_keeps_by_key_and_order(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", 1, base), ("a", 2, base + dt.timedelta(hours=1)), ("b", 1, base), ("b", 2, base + dt.timedelta(hours=9)), (None, 1, base), (None, 2, base + dt.timedelta(hours=2)), ("c", 1, base), ("c", 1, base + dt.timedelta(hours=1)), ("c", 1, base + dt.timedelta(hours=7))]
    got = events.dedupe(spark.createDataFrame(rows, "k string, o long, ts timestamp"), F.col("k"), "o", "ts").select("k", "o", (F.unix_timestamp("ts") - int(base.replace(tzinfo=dt.timezone.utc).timestamp())).alias("s")).collect()
    assert sorted(((r.k or "", r.o, r.s // 3600) for r in got)) == [("", 1, 0), ("a", 1, 0), ("b", 1, 0), ("b", 2, 9), ("c", 1, 0), ("c", 1, 7)]


def test_dedupe_equals_a_loop_on_bursts(spark):
    rng = np.random.default_rng(2)
    base = dt.datetime(2024, 1, 1)
    rows = [(int(rng.integers(3)), i, base + dt.timedelta(minutes=int(rng.integers(0, 6000)))) for i in range(300)]
    last, want = {}, []
    for k, i, ts in rows:
        if k not in last or ts - last[k] >= dt.timedelta(hours=6):
            last[k] = ts
            want.append(i)
    got = events.dedupe(spark.createDataFrame(rows, "k int, o long, ts timestamp"), F.col("k"), "o", "ts").collect()
    assert sorted(r.o for r in got) == want


@pytest.mark.parametrize("alpha", [0.02, 1 / 14, 0.5, 0.999])
def test_means_over_many_blocks_equal_pandas(spark, alpha):
    rng = np.random.default_rng(3)
    x = pd.Series(rng.standard_normal(30_000)).where(rng.random(30_000) > 0.2)
    whole = x.fillna(1.0)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "dt": range(len(x)), "x": x, "y": whole})).withColumn("x", F.nullif(F.col("x"), F.lit(float("nan"))))
    got = ewms(df, {"a": Mean(F.col("x"), alpha), "b": Mean(F.col("y"), alpha, False, 5)}).orderBy("dt").toPandas()
    assert np.allclose(got["a"].astype(float), x.ewm(alpha=alpha).mean(), equal_nan=True, rtol=1e-12, atol=1e-12)
    assert np.allclose(got["b"].astype(float), whole.ewm(alpha=alpha, adjust=False, min_periods=5).mean(), equal_nan=True, rtol=1e-12, atol=1e-12)


def test_recurrences_with_a_decay_of_each_key(spark):
    df = spark.createDataFrame([(k, t, float(t % 5), d) for k, d in (("a", 0.9), ("b", 0.2)) for t in range(900)], "series_id string, dt int, u double, d double")
    got = recurrences(df, {"y": (F.col("u"), F.col("d"))}).collect()
    for k, d in (("a", 0.9), ("b", 0.2)):
        y = 0.0
        for r in sorted((r for r in got if r.series_id == k), key=lambda r: r.dt):
            y = d * y + r.dt % 5
            assert abs(r.y - y) < 1e-9


def test_continuous_prices_by_a_loop(spark):
    spans = {"c1": range(0, 12), "c2": range(10, 25), "c3": range(22, 40)}
    rows = [("s", c, day(n), 100.0 + n + 7 * k) for k, (c, span) in enumerate(spans.items()) for n in span]
    got = {r.dt: r for r in align.continuous(spark.createDataFrame(rows, "series_id string, contract string, dt date, close double")).collect()}
    front = [(c, day(n), 100.0 + n + 7 * k) for k, (c, span) in enumerate(spans.items()) for n in span if k == 2 or n < list(spans.values())[k + 1][0]]
    factor, want = 1.0, {}
    for (c, d, p), after in zip(reversed(front), [None, *reversed(front)], strict=False):
        if after is not None and after[0] != c:
            factor *= after[2] / p
        want[d] = (c, p * factor)
    assert {d: r.contract for d, r in got.items()} == {d: c for d, (c, _) in want.items()}
    assert all(abs(got[d].adjusted - p) < 1e-9 for d, (_, p) in want.items())


def test_rolling_fit_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.standard_normal(140)) * 0.3
    got = align.rolling_fit(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, dt int, close double"), 50, 20).orderBy("dt").collect()
    want = []
    for i in range(50, 140, 20):
        w = x[i - 50 : i]
        want.append((i - 1, np.polyfit(w[:-1], np.diff(w), 1)[0]))
    assert [r.dt for r in got] == [d for d, _ in want] and np.allclose([r.slope for r in got], [s for _, s in want])


def test_zscores_over_lengths_of_their_own(spark):
    rng = np.random.default_rng(6)
    rows = [(k, i, float(rng.standard_normal() + 1e6), n) for k, n in (("a", 7), ("b", 20)) for i in range(60)]
    got = rolling.zscore_by_length(spark.createDataFrame(rows, "series_id string, dt int, x double, n int"), "x", "n").toPandas()
    for k, n in (("a", 7), ("b", 20)):
        s = pd.Series({i: x for key, i, x, _ in rows if key == k})
        want = (s - s.rolling(n, min_periods=n // 2).mean()) / s.rolling(n, min_periods=n // 2).std()
        mine = got[got.series_id == k].sort_values("dt")["z"].astype(float).to_numpy()
        assert np.allclose(mine, want, equal_nan=True, atol=1e-5)


def test_keyed_carry_has_all_dates_of_the_keys(spark):
    rows = spark.createDataFrame([("a", day(0), 1.0), ("b", day(2), 2.0), ("a", day(3), None), ("c", day(4), 5.0)], "key string, dt date, value double")
    got = [tuple(r) for r in align.keyed_carry(rows, ["a", "b", "z"]).orderBy("dt").collect()]
    assert got == [(day(0), 1.0, None, None), (day(2), 1.0, 2.0, None), (day(3), 1.0, 2.0, None)]


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
def test_expanding_ranks_equal_pandas(spark, block):
    rng = np.random.default_rng(7)
    series = {"a": pd.Series(rng.integers(0, 12, 150).astype(float)), "b": pd.Series(np.ones(60)), "c": pd.Series(rng.standard_normal(40)).where(rng.random(40) > 0.3), "d": pd.Series([np.nan])}
    rows = [(k, t, None if x != x else float(x)) for k, s in series.items() for t, x in enumerate(s)]
    got = rolling.expanding_rank(spark.createDataFrame(rows, "series_id string, dt int, x double"), "x", "p", block).toPandas()
    for k, s in series.items():
        mine = got[got.series_id == k].sort_values("dt")["p"].astype(float).to_numpy()
        assert np.allclose(mine, s.expanding().rank(pct=True), equal_nan=True)
