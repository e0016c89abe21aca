"""Positioning scores: the normal quantile, gaps, short series."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import positioning


def test_normal_quantile(spark):
    shares = [0.001, 0.01, 0.02425, 0.3, 0.5, 0.8, 0.97575, 0.99, 0.999]
    got = spark.createDataFrame([(p,) for p in shares], "p double").select("p", F.expr(positioning.normal_quantile("p")).alias("x")).collect()
    for r in got:
        assert abs(r.x - NormalDist().inv_cdf(r.p)) < 1e-8


def test_scores(spark):
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.standard_normal((160, 4)), axis=0) + 50
    rows = [("a", t, *map(float, walk[t])) for t in range(160)] + [("short", t, 1.0, 1.0, 1.0, 1.0) for t in range(5)]
    rows[150] = ("a", 150, None, None, None, None)
    df = spark.createDataFrame(rows, "series_id string, dt int, spot double, rr_short double, rr_long double, net double")
    got = {(r.series_id, r.dt): r for r in positioning.scores(df, 20, 30, 4).collect()}
    assert len(got) == 165 and all(got["short", t].score is None for t in range(5))
    have = [r for r in got.values() if r.score is not None]
    assert have and all(-50 < r.score <= 50 for r in have)
    assert got["a", 150].composite is not None
    r = got["a", 159]
    assert abs(r.composite - (r.rr + r.trend + r.net_score) / 3) < 1e-12
    last = {d: [g for (_, t), g in got.items() if t == d and g.score is not None] for d in (159,)}[159]
    usd = positioning.against(positioning.scores(df, 20, 30, 4)).filter("dt = 159").first().score
    assert abs(usd + np.mean([g.score for g in last])) < 1e-9
