"""Decayed totals of micro-batches in ranges against the stream with a state, over two batches with ties, nulls and late events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.streaming import jobs


def test_totals_in_ranges_equal_sums(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 400
    frame = pd.DataFrame({"event_class": rng.choice(["signup", "other", None], n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 60 * 86400, n)), "s"), "imp": rng.integers(-2, 3, n).astype(float)})
    rows = spark.createDataFrame(frame, "event_class string, ts timestamp, imp double")
    step = jobs.totals_of_batches(str(tmp_path))
    cut = F.lit("2024-02-01").cast("timestamp")
    parts = [rows.filter(F.col("ts") < cut), rows.filter((F.col("ts") >= cut) & F.col("event_class").isNotNull())]
    step(parts[0], 0)
    step(parts[1], 1)
    step(parts[1], 1)
    got = spark.read.parquet(f"{tmp_path}/totals").toPandas()
    kept = pd.concat([p.toPandas() for p in parts])
    assert len(got) == len(kept)
    for name, (fast, slow, weight) in {"signup": (0.5, 3.0, 0.7), "other": (0.25, 1.0, 0.8)}.items():
        mine, want = got[got["event_class"] == name].sort_values("ts"), kept[kept["event_class"] == name].sort_values("ts")
        day = want["ts"].to_numpy("datetime64[us]").astype(float) / 86400e6
        back = day[:, None] - day[None]
        of = np.where(back >= 0, weight * 0.5 ** (np.abs(back) / fast) + (1 - weight) * 0.5 ** (np.abs(back) / slow), 0)
        assert len(mine) > 100 and np.allclose(mine["score"], of @ want["imp"].to_numpy(), atol=1e-8)
    assert spark.read.parquet(f"{tmp_path}/sums/n=1").count() == 3
    chunk = pd.DataFrame({"event_class": ["a"] * 10, "__part": 0, "ts": pd.Timestamp("2024-01-01"), "days": np.arange(10.0), "x_f": 1.0, "x_s": 0.0, "rate_f": 1.0, "rate_s": 1.0, "at0": 0.0, "f0": 0.0, "s0": 0.0})
    cut_up = [len(p) for p in jobs._scores(chunk.iloc[k : k + 2] for k in range(0, 10, 2))]
    assert cut_up == [2] * 5
