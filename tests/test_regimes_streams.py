"""Switching fits and stateful streams against their batch forms."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import events, longregimes, regimes, state
from tidemark.streaming import jobs


def test_switching_fit_tells_calm_from_wild():
    rng = np.random.default_rng(0)
    wild = np.repeat([False, True, False, True], 100)
    x = np.stack([rng.standard_normal(400) * np.where(wild, 5.0, 1.0), np.ones(400)])
    got = regimes.switching_fit(x, states=2)
    assert got.deviation[0, 0] < 1.5 < 3 < got.deviation[0, 1]
    assert np.allclose(got.move.sum(axis=2), 1) and np.allclose(got.smoothed.sum(axis=2), 1) and np.allclose(got.filtered.sum(axis=2), 1)
    assert ((got.smoothed[0, :, 1] > 0.5) == wild[1:]).mean() > 0.9
    # A constant window can't be fitted, and others of its batch don't suffer.
    assert got.status.tolist() == ["ok", "uniform"] and np.allclose(got.smoothed[1], 0.5)


def test_switching_fit_finds_three_states_and_their_lags():
    rng = np.random.default_rng(1)
    kind = np.repeat([0, 1, 2, 1, 0, 2], 250)
    x = np.zeros(len(kind))
    for t in range(1, len(x)):
        x[t] = (0.6, 0.0, -0.5)[kind[t]] * x[t - 1] + (0.3, 1.5, 6.0)[kind[t]] * rng.standard_normal()
    got = regimes.switching_fit(x[None, :], rounds=100)
    assert got.status[0] == "ok" and (np.diff(got.deviation[0]) > 0).all()
    assert abs(got.lag[0, 0] - 0.6) < 0.15 and abs(got.lag[0, 2] + 0.5) < 0.2
    assert (got.smoothed[0].argmax(axis=1) == kind[1:]).mean() > 0.9


def test_propagated_states_stay_probabilities():
    got = regimes.propagated(np.array([1.0, 0.0]), np.array([[0.9, 0.1], [0.2, 0.8]]), 200)
    assert np.allclose(got[0], [0.9, 0.1]) and np.allclose(got.sum(axis=1), 1) and np.allclose(got[-1], [2 / 3, 1 / 3])


def test_rolling_regimes_serve_each_later_row_once(spark):
    rows = [("a", t, t + 1, float(np.sin(t * t))) for t in range(95)] + [("b", t, t + 1, 1.0) for t in range(5)]
    got = regimes.rolling_regimes(spark.createDataFrame(rows, "series_id string, dt int, rn int, x double"), "x", 50, 20).collect()
    assert sorted(r.dt for r in got) == list(range(50, 95))
    assert {r.fold for r in got} == {0, 1, 2} and all(abs(r.p_ranging + r.p_trending + r.p_crisis - 1) < 1e-9 for r in got)


def test_switching_probs_of_each_series(spark):
    rows = [(k, t, float(np.sin(t * t)) * (1 + 9 * (t > 60))) for k in ("a", "b") for t in range(120)] + [("c", 0, 1.0), ("d", 0, None)]
    got = regimes.switching_probs(spark.createDataFrame(rows, "series_id string, dt int, x double"), "x", 2).collect()
    assert sorted((r.series_id, r.dt) for r in got) == [(k, t) for k in ("a", "b") for t in range(1, 120)]
    assert all((r.p_trending > 0.5) == (r.dt > 60) for r in got if not 55 < r.dt < 66)


def test_streamed_positions_equal_batch(spark, tmp_path):
    zs = [0.0, 2.0, 1.0, None, 0.2, -1.8, -1.0, 3.0, 0.1, 1.4, 1.6, 0.6]
    rows = spark.createDataFrame([(s, t, z if s == "a" or z is None else -z) for s in "ab" for t, z in enumerate(zs)], "series_id string, dt int, z double")
    for n, part in enumerate((rows.filter("dt < 5"), rows.filter("dt >= 5"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p={n}"))
    stream = spark.readStream.schema("series_id string, dt int, z double, p int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    out = jobs.positions(stream.select("series_id", "dt", "z"), 1.5, 0.5)
    run = out.writeStream.format("memory").queryName("positions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r.series_id, r.dt, r.position) for r in spark.table("positions").collect())
    want = sorted((r.series_id, r.dt, r.position) for r in state.hysteresis(rows, F.col("z"), 1.5, 0.5).collect())
    assert got == want


def test_filed_marks_late_days(spark):
    sub = spark.createDataFrame([("d1", 1, "a"), ("d1", 2, "  "), ("d2", 3, "b"), (None, 4, "c")], "day string, ts int, raw string")
    closed = spark.createDataFrame([("d1",), ("d1",)], "day string")
    assert sorted((r.ts, r.late) for r in jobs.filed(sub, closed).collect()) == [(1, True), (3, False), (4, False)]


def streamed(spark, tmp_path, name, parts, job):
    """Rows of a stream whose micro-batches are the given frames."""
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    run = job(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == len(parts)
    return spark.table(name).collect()


def test_streamed_dedupe_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(k, int(rng.integers(0, 3)), base + dt.timedelta(minutes=int(k * 9 + rng.integers(-300, 300)))) for k in range(300)] + [(300, 1, None), (301, 9, base)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp")
    got = streamed(spark, tmp_path, "apart", [df.filter(F.floor(F.col("id") / 101) == n) for n in range(3)], lambda s: jobs.kept_apart(s, "k", "id", late="100 days"))
    want = events.dedupe(df, F.col("k"), "id", "ts").collect()
    assert sorted(r.id for r in got) == sorted(r.id for r in want) and len(want) > 10


def test_quiet_keys_are_forgotten_by_a_timer(spark, tmp_path):
    day = lambda d, k, i: (i, k, dt.datetime(2024, 1, d))
    parts = [[day(1, 1, 0), day(1, 2, 1)], [day(9, 2, 2)], [day(20, 2, 3)], [day(20, 1, 4), (5, 1, dt.datetime(2024, 1, 20, 1))]]
    frames = [spark.createDataFrame(p, "id long, k long, ts timestamp") for p in parts]
    assert sorted(r.id for r in streamed(spark, tmp_path, "quiet", frames, lambda s: jobs.kept_apart(s, "k", "id", late="1 day"))) == [0, 1, 2, 3, 4]


def test_filing_log_over_batches(spark, tmp_path):
    rows = [("d1", 1, "EUR up", "file", False), ("d1", 2, "  ", "file", False), ("d2", 3, "b", "file", False), ("d1", 4, "c", "file", None),
            ("d1", 5, None, "close", False), ("d1", 6, "late", "file", False), ("d1", 7, "forced", "file", True), ("d2", 8, None, "close", True),
            ("d2", 9, "late but allowed", "file", False), ("d1", 10, "late too", "file", False), ("d1", 11, "forced again", "file", True), ("d1", 12, None, "file", True)]
    frames = [spark.createDataFrame(rows[a:b], "day string, ord long, raw string, kind string, flag boolean") for a, b in ((0, 4), (4, 8), (8, 12))]
    got = sorted((r.day, r.ord, r.seq, r.status, r.late) for r in streamed(spark, tmp_path, "filings", frames, jobs.filing_log))
    assert got == [("d1", 1, 1, "open", False), ("d1", 4, 2, "open", False), ("d1", 7, 3, "closed", True), ("d1", 11, 4, "closed", True), ("d2", 3, 1, "open", False), ("d2", 9, 2, "closed", True)]
    one = streamed(spark, tmp_path, "at_once", [spark.createDataFrame(rows, frames[0].schema)], jobs.filing_log)
    assert sorted((r.day, r.ord, r.seq, r.status, r.late) for r in one) == got


def test_vectorised_steps_equal_loops():
    rng = np.random.default_rng(3)
    for _ in range(300):
        z = np.where(rng.random(40) < 0.1, np.nan, rng.standard_normal(40) * 2)[: rng.integers(0, 41)]
        held = start = int(rng.integers(-1, 2))
        want = []
        for v in z:
            if np.isnan(v):
                want.append(0)
                continue
            if held and abs(v) < 0.5:
                held = 0
            elif not held and abs(v) > 1.5:
                held = -1 if v > 0 else 1
            want.append(held)
        got, after = jobs.held_positions(z, start, 1.5, 0.5, -1)
        assert got.tolist() == want and after == held
    at, x = np.sort(rng.random(200) * 4000), rng.standard_normal(200)
    got = jobs.decayed_sums(at, x, 2.0, 0.0, 0.7)
    want = [2 * np.exp(-0.7 * t) + (x[: k + 1] * np.exp(-0.7 * (t - at[: k + 1]))).sum() for k, t in enumerate(at)]
    assert np.allclose(got, want, atol=1e-12)


def test_switching_model_over_blocks_equals_the_whole_fit(spark):
    rng = np.random.default_rng(1)
    kind = np.repeat([0, 1, 2, 1, 0, 2], 20)
    x = np.zeros(len(kind))
    for t in range(1, len(x)):
        x[t] = (0.6, 0.0, -0.5)[kind[t]] * x[t - 1] + (0.3, 1.5, 6.0)[kind[t]] * rng.standard_normal()
    rows = [("a", t, float(v)) for t, v in enumerate(x)] + [("flat", t, 1.0) for t in range(20)] + [("short", t, float(t)) for t in range(4)] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "series_id string, dt int, x double")
    want = regimes.switching_fit(x[None, :], 3, rounds=3)
    # Blocks of 31 rows, so that borders are crossed.
    got = longregimes.switching_probs(df, "x", 3, rounds=3, size=31).toPandas().sort_values(["series_id", "dt"])
    mine = got[got["series_id"] == "a"]
    assert mine["dt"].tolist() == list(range(1, len(x))) and set(mine["status"]) == {want.status[0]} == {"ok"}
    for c, p in (("p", want.smoothed), ("f", want.filtered)):
        assert np.allclose(mine[[f"{c}_{n}" for n in regimes.NAMES]], p[0], atol=1e-10)
    rest = got[got["series_id"] != "a"]
    assert len(rest) == 19 + 3 and set(rest["status"]) == {"uniform"} and np.allclose(rest.filter(like="p_"), 1 / 3)


def test_folds_take_the_last_state_of_their_training_rows(spark):
    rng = np.random.default_rng(4)
    calm, wild = rng.standard_normal(60), rng.standard_normal(60) * 8
    rows = [("a", k, t, float(v)) for k, x in enumerate((np.r_[calm, wild], np.r_[wild, calm])) for t, v in enumerate(x)] + [("b", 0, t, 1.0) for t in range(5)] + [("a", 0, 999, None)]
    got = {(r.series_id, r.fold): r for r in regimes.fold_regimes(spark.createDataFrame(rows, "series_id string, fold int, dt int, r double"), "r", states=2).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0)} and got["b", 0].status == "uniform" and got["b", 0].ranging == 0.5
    for (k, fold), x in {("a", 0): np.r_[calm, wild], ("a", 1): np.r_[wild, calm]}.items():
        want = regimes.switching_fit(x[None, :], 2)
        assert np.allclose([got[k, fold].ranging, got[k, fold].trending], want.smoothed[0, -1])
    assert got["a", 0].trending > 0.9 > 0.1 > got["a", 1].trending
