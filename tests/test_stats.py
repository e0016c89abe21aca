"""p-values against tables of Student's distribution and integration."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import stats


def integrated(t: float, n: float) -> float:
    """1 - P(|T| <= t) by Simpson's rule over the angle."""
    top, steps = math.atan(abs(t) / math.sqrt(n)), 20_000
    w = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * math.cos(top * i / steps) ** (n - 1) for i in range(steps + 1))
    return 1 - 2 * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi) * w * top / steps / 3


def test_p_values(spark):
    # Quantiles of printed tables: 0.975 for 1, 2, 10, 30 and 120 degrees of freedom.
    known = [(12.7062047362, 1, 0.05), (4.30265272991, 2, 0.05), (2.22813885196, 10, 0.05), (2.04227245630, 30, 0.05), (1.97993040505, 120, 0.05), (0.0, 7, 1.0), (-12.7062047362, 1, 0.05)]
    known += [(t, n, integrated(t, n)) for n in (1, 2, 3, 5, 17, 100, 355, 1000, 10_000) for t in (0.01, 0.7, 1.65, 2.86, 3.5)]
    df = spark.createDataFrame([(float(t), float(n), p) for t, n, p in known], "t double, n double, p double")
    for r in df.withColumn("got", stats.t_p_value(F.col("t"), F.col("n"))).collect():
        assert abs(r.got - r.p) < 1e-8, r
    odd = spark.createDataFrame([(None, 5.0), (1.0, None), (1.0, 0.0)], "t double, n double")
    assert [r.p for r in odd.select(stats.t_p_value(F.col("t"), F.col("n")).alias("p")).collect()] == [None, None, None]


def test_incomplete_beta_and_gamma(spark):
    rows = [(x, a, b) for x in (0.0, 0.1, 0.5, 0.9, 1.0) for a in (0.5, 1.0, 3.0, 40.0) for b in (0.5, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "x double, a double, b double")
    for r in df.withColumns({"s": stats.beta_share(F.col("x"), F.col("a"), F.col("b")), "m": stats.beta_share(1 - F.col("x"), F.col("b"), F.col("a")), "g": stats.log_gamma(F.col("a"))}).collect():
        assert abs(r.s + r.m - 1) < 1e-12 and abs(r.g - math.lgamma(r.a)) < 1e-12
        if r.b == 1.0:
            assert abs(r.s - r.x**r.a) < 1e-12
