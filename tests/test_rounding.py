"""Results rounded to six places, whatever their size."""

from __future__ import annotations

import math

from tidemark.plans.registry import rounded


def test_large_values_and_no_numbers_are_kept(spark):
    x = [1.2345678, -1.2345678, 9.3e12, -1.5e13, 1e300, math.inf, -math.inf, None, math.nan]
    got = [r.x for r in rounded(spark.createDataFrame([(v,) for v in x], "x double").coalesce(1)).collect()]
    assert got[:8] == [1.234568, -1.234568, 9.3e12, -1.5e13, 1e300 * 1e6 / 1e6, math.inf, -math.inf, None] and math.isnan(got[8])
