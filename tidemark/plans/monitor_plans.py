"""The monitor of volatility and carry: the latest row of each series against the fitted variance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import rolling
from tidemark.operators.rolling import lag, roll
from tidemark.plans import sqltext as S
from tidemark.plans.boards import LAST, last
from tidemark.plans.fit_plans import _FIT, variance_regression
from tidemark.plans.registry import query
from tidemark.plans.series_plans import B, bars

#: Days of the tenor, and how many of its sigmas, of the forecast and of inversion make a squeeze.
DAYS, MOVE, RICH = 7, 1.2, 1.2


@query("bd5_vol_carry_monitor", f"""{B.replace('WITH', f'WITH fit AS ({_FIT}),', 1)}, t AS (SELECT series_id, dt, close AS spot, lag(close) {S.W} AS before, iv, ({S.roll('r', 21, 'stddev_samp')}) * sqrt(252::DOUBLE) * 100 AS rv, iv - ({S.roll('iv', 26)}) AS term_spread,
  ({S.roll('iv', 13)}) - ({S.roll('iv', 52)}) AS carry, min(close) {S.frame(63)} AS lo, max(close) {S.frame(63)} AS hi, count(close) {S.frame(63)} AS n FROM b {LAST}),
j AS (SELECT t.*, CASE WHEN forecast IS NOT NULL THEN sqrt(greatest(forecast, 0) * 252) END AS fitted_vol, carry / nullif(iv, 0) AS carry_ratio FROM t LEFT JOIN fit USING (series_id))
SELECT series_id, dt, spot, CASE WHEN n >= 5 THEN CASE WHEN hi > lo THEN (spot - lo) / (hi - lo) * 100 ELSE 50 END END AS spot_place, iv, rv, fitted_vol, term_spread, carry, carry_ratio,
  CASE WHEN carry_ratio IS NULL THEN 'N/A' WHEN carry_ratio < 0 THEN 'AVOID' WHEN carry_ratio < 0.5 THEN 'UNATTRACTIVE' WHEN carry_ratio < 1.5 THEN 'NEUTRAL' ELSE 'ATTRACTIVE' END AS label,
  coalesce(abs(spot - before) > {MOVE} * spot * iv / 100 * sqrt({DAYS} / 365.0::DOUBLE) AND iv > {RICH} * fitted_vol AND fitted_vol > 0 AND term_spread > 0, FALSE) AS squeeze FROM j""",
    ["spot", "spot_place", "iv", "rv", "fitted_vol", "term_spread", "carry", "carry_ratio"])
def monitor(spark, sf):
    """BD5, AG16, PR16: place in the range of 63 rows, implied, realised and fitted volatility, carry, and squeezes."""
    of = rolling.series().rowsBetween(-62, 0)
    c, iv = F.col("close"), F.col("iv")
    b = bars(spark, sf).withColumns({
        "before": lag(c), "rv": rolling.realised_vol(F.col("r"), 21), "term_spread": iv - roll(iv, 26), "carry": roll(iv, 13) - roll(iv, 52),
        "lo": F.min(c).over(of), "hi": F.max(c).over(of), "n": F.count(c).over(of),
    })
    t = last(b.withColumn("spot", c), ["spot", "before", "iv", "rv", "term_spread", "carry", "lo", "hi", "n"])
    t = t.join(variance_regression(spark, sf).select("series_id", "forecast"), "series_id", "left")
    t = t.withColumns({"fitted_vol": F.when(F.col("forecast").isNotNull(), F.sqrt(F.greatest("forecast", F.lit(0.0)) * 252)), "carry_ratio": F.col("carry") / F.nullif(iv, F.lit(0.0))})
    spot, ratio, fitted = F.col("spot"), F.col("carry_ratio"), F.col("fitted_vol")
    place = F.when(F.col("hi") > F.col("lo"), (spot - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100).otherwise(50.0)
    label = F.when(ratio.isNull(), "N/A").when(ratio < 0, "AVOID").when(ratio < 0.5, "UNATTRACTIVE").when(ratio < 1.5, "NEUTRAL").otherwise("ATTRACTIVE")
    squeeze = (F.abs(spot - F.col("before")) > MOVE * spot * iv / 100 * (DAYS / 365) ** 0.5) & (iv > RICH * fitted) & (fitted > 0) & (F.col("term_spread") > 0)
    return t.select(
        "series_id", "dt", "spot", F.when(F.col("n") >= 5, place).alias("spot_place"), "iv", "rv", "fitted_vol", "term_spread", "carry", "carry_ratio",
        label.alias("label"), F.coalesce(squeeze, F.lit(False)).alias("squeeze"),
    )
