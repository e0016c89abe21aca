"""Series in blocks against windows over whole series, at small block sizes, with ties, nulls and hot keys."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events, hot, rolling, state
from tidemark.operators.ewm import Mean, ewms
from tidemark.sources import sinks


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k, n in (("hot", 900), ("small", 7), ("one", 1), (None, 40)):
        x = np.cumsum(rng.standard_normal(n)).round(1) + 100
        rows += [(k, t, None if rng.random() < 0.05 else float(v)) for t, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "series_id string, dt long, close double").repartition(5).cache()


def same(got, want, exact=True):
    order = lambda df: df.toPandas()[want.columns].sort_values(["series_id", "dt"], na_position="first").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, check_exact=exact)


def test_places_are_those_of_a_window(spark, walk):
    same(hot.placed(walk), walk.withColumn("__place", F.row_number().over(rolling.series()) - 1))


@pytest.mark.parametrize("size", [1, 25, 64, 10_000])
def test_windows_with_a_halo(spark, walk, size):
    c = F.col("close")
    steps = lambda w: [{"r": rolling.lag(c, w=w)}, {"m": rolling.roll(c, 20, w=w), "z": rolling.zscore(c, 25, 10, w), "rv": rolling.realised_vol(F.col("r"), 20, w=w)}]
    want = walk
    for step in steps(None):
        want = want.withColumns(step)
    got = hot.in_blocks(walk, 25, [lambda w: steps(w)[0], lambda w: steps(w)[1]], size=size)
    same(got, want, exact=False)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_running_values_and_states(spark, walk, size):
    c = F.col("close")
    got = hot.running(walk, {"s": ("sum", c), "n": ("count", c), "hi": ("max", c), "lo": ("min", c)}, size=size)
    over = state.running()
    same(got, walk.withColumns({"s": F.sum(c).over(over), "n": F.count(c).over(over), "hi": F.max(c).over(over), "lo": F.min(c).over(over)}), exact=False)
    same(hot.drawdown(walk, c, size=size), walk.withColumn("drawdown", state.drawdown(c)))
    z = (c - 100) / 3
    same(hot.hysteresis(walk, z, 1.0, 0.4, size=size), state.hysteresis(walk, z, 1.0, 0.4))
    below = c < 99
    runs = lambda df: sorted(((str(r.series_id), r.longest) for r in df.collect()))
    assert runs(hot.longest_run(walk, below, size=size)) == runs(state.longest_run(walk, below))
    with pytest.raises(ValueError, match="leave"):
        hot.hysteresis(walk, z, 1, 2)


@pytest.mark.parametrize("size", [3, 50])
def test_exponential_means_over_blocks(spark, walk, size):
    c = F.col("close")
    filled = walk.filter("close is not null")
    for df, means in ((walk, {"a": Mean(c, 0.2), "b": Mean(c, 0.05, True, 10), "one": Mean(c, 1.0)}), (filled, {"c": Mean(c, 0.1, False), "one": Mean(c, 1.0, False)})):
        same(hot.ewms(df, means, size=size), ewms(df, means), exact=False)


def test_positions_held_over_many_blocks(spark):
    z = [2.0, *[1.0] * 30, None, *[1.0] * 9, 0.1, *[0.7] * 10, -3.0, *[None] * 12, 5.0, 0.0, 0.9]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(z)], "series_id string, dt int, z double")
    for size in (1, 3, 8):
        same(hot.hysteresis(df, F.col("z"), 1.5, 0.5, size=size), state.hysteresis(df, F.col("z"), 1.5, 0.5))


@pytest.mark.parametrize("n", [1, 2, 52, 2000])
def test_rolling_ranks(spark, walk, n):
    frame = walk.toPandas().sort_values(["series_id", "dt"], na_position="first").reset_index(drop=True)
    for size in (16, 1 << 14):
        got = rolling.rolling_rank(rolling.rolling_rank(walk, "close", n, "p", 1, size=size), "close", n, "q", n - 1, below=True, size=size).toPandas()
        got = got.sort_values(["series_id", "dt"], na_position="first").reset_index(drop=True)
        for (_, part), (_, mine) in zip(frame.groupby("series_id", dropna=False), got.groupby("series_id", dropna=False), strict=True):
            v = part["close"].to_numpy()
            for i, (p, q) in enumerate(zip(mine["p"], mine["q"], strict=True)):
                window, before = v[max(0, i - n + 1) : i + 1], v[max(0, i - n + 1) : i]
                window, before = window[~np.isnan(window)], before[~np.isnan(before)]
                want = ((window < v[i]).sum() + ((window == v[i]).sum() + 1) / 2) / len(window) if not np.isnan(v[i]) else None
                assert (want is None and np.isnan(p)) or abs(p - want) < 1e-12
                assert abs(q - 100 * (before < v[i]).mean()) < 1e-9 if len(before) >= max(1, n - 1) else np.isnan(q)


def test_quantiles(spark, walk):
    shares = [0.0, 0.1, 0.5, 0.85, 1.0]
    got = {r.series_id: tuple(r)[1:] for r in hot.quantiles(walk, "close", shares).collect()}
    want = {r.series_id: tuple(r)[1:] for r in walk.filter("close is not null").groupBy("series_id").agg(*(F.percentile("close", s) for s in shares)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    ties = spark.createDataFrame([("a", 1.0)] * 500 + [("a", 2.0)], "series_id string, x double")
    assert tuple(hot.quantiles(ties, "x", [0.5, 1.0]).first()) == ("a", 1.0, 2.0)
    assert hot.quantiles(ties.limit(0), "x", [0.5]).count() == 0


def kept(rows, hours):
    last, out = {}, []
    for o, k, t in sorted(rows, key=lambda r: (r[0], r[2] or dt.datetime.min)):
        if t is not None and (k not in last or t - last[k] >= dt.timedelta(hours=hours)):
            last[k] = t
            out.append((o, str(k)))
    return sorted(out)


@pytest.mark.parametrize("hours", [6, 0.05])
def test_dedupe_of_a_hot_key(spark, hours):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 9 + ["b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * 3 + rng.randrange(-600, 600)) if rng.random() < 0.97 else None) for i in range(2500)]
    rows += rows[:40]
    got = events.dedupe(spark.createDataFrame(rows, "o long, k string, ts timestamp"), F.col("k"), "o", "ts", hours)
    assert sorted((r.o, str(r.k)) for r in got.collect()) == kept(rows, hours)
    assert events.dedupe(got.limit(0), F.col("k"), "o", "ts").count() == 0


def test_dedupe_whose_ranges_all_depend_on_the_one_before(spark):
    # Events just under the gap apart: what a range keeps depends on how it is entered, so each pass mends one range more.
    rows = [(i, "k", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 3)) for i in range(101)]
    got = events.dedupe(spark.createDataFrame(rows, "o long, k string, ts timestamp"), F.col("k"), "o", "ts", 6)
    assert sorted((r.o, r.k) for r in got.collect()) == kept(rows, 6)


def test_decay_of_nothing_is_the_value_itself(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate([1.0, 2.0, 0.0, 4.0, 5.0])], "series_id string, dt int, x double")
    for adjust in (True, False):
        got = ewms(df, {"m": Mean(F.col("x"), 1.0, adjust), "slow": Mean(F.col("x"), 0.5, adjust)}).orderBy("dt").toPandas()
        assert got["m"].tolist() == got["x"].tolist()
        assert np.allclose(got["slow"], got["x"].ewm(alpha=0.5, adjust=adjust).mean())


def test_long_days_are_written_in_ordered_parts(spark, tmp_path):
    rows = [("d1", "beta" if k % 3 else None, k, f"line {k}") for k in range(300)] + [("d2", "x", 1, "one")]
    sinks.day_report(spark.createDataFrame(rows, "day string, grp string, seq int, text string"), str(tmp_path / "out"), "day", "grp", "seq", "text", rows=50)
    files = sorted((tmp_path / "out/day=d1").glob("part-*.txt"), key=lambda f: (f.name.split("-")[1], f.name.rsplit(".c", 1)[-1]))
    lines = [line for f in files for line in f.read_text().splitlines()]
    want = [line for head, some in (("BETA", True), ("GENERAL", False)) for line in [f"## {head}", *(f"- line {k}" for k in range(300) if bool(k % 3) is some)]]
    assert lines == want and max(len(f.read_text().splitlines()) for f in files) <= 50
    assert (next((tmp_path / "out/day=d2").glob("part-*.txt"))).read_text() == "## X\n- one\n"
