"""Positioning scores over the weekly bars, and the scorecard that joins the boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import positioning
from tidemark.operators.rolling import lag, roll, zscore
from tidemark.plans import sqltext as S
from tidemark.plans.boards import LAST, last
from tidemark.plans.pair_plans import BD2, BD3, SPOT, activity_board, carry_board, spots
from tidemark.plans.registry import query
from tidemark.plans.series_plans import B, bars

WINDOW, LEVEL, CHANGE = 52, 104, 4
_Z = lambda x: S.z(x, WINDOW, int(WINDOW * 0.8))


def _rank(src: str, x: str, n: int, least: int, out: str) -> str:
    return f"""(SELECT c.*, j.{out} FROM {src} c JOIN (SELECT a.series_id, a.rn, CASE WHEN count(e.{x}) >= {least} THEN (sum((e.{x} < a.{x})::INT) + (sum((e.{x} = a.{x})::INT) + 1) / 2.0::DOUBLE) / count(e.{x}) END AS {out}
  FROM {src} a JOIN {src} e ON e.series_id = a.series_id AND e.rn BETWEEN a.rn - {n - 1} AND a.rn GROUP BY a.series_id, a.rn) j ON j.series_id = c.series_id AND j.rn = c.rn)"""


_SCORES = f"""{B}, i AS (SELECT series_id, dt, rn, close AS spot, iv AS rr_short, {S.roll('iv', 6)} AS rr_long, CASE WHEN rn % 11 NOT BETWEEN 5 AND 9 THEN volume - {S.roll('volume', 4)} END AS held, close - lag(close) {S.W} AS d FROM b),
i2 AS (SELECT *, last_value(held IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS net FROM i),
g AS (SELECT *, {S.roll('greatest(d, 0)', 14).replace('count(greatest(d, 0))', 'count(d)')} AS up, {S.roll('greatest(-d, 0)', 14).replace('count(greatest(-d, 0))', 'count(d)')} AS dn, spot - {S.roll('spot', 20)} AS d20, spot - {S.roll('spot', 100)} AS d100,
  net - lag(net, {CHANGE}) {S.W} AS chg FROM i2),
h AS (SELECT series_id, dt, rn, rr_short, rr_long, net, d20, d100, chg, CASE WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) WHEN up > 0 THEN 100 END AS rsi FROM g),
k AS {_rank('h', 'net', LEVEL, int(LEVEL * 0.8), 'rk')},
z AS (SELECT series_id, dt, rn, 0.4::DOUBLE * ({_Z('rr_short')}) + 0.6::DOUBLE * ({_Z('rr_long')}) AS rr, {_Z('rsi')} AS z1, {_Z('d20')} AS z2, {_Z('d100')} AS z3, {_Z('chg')} AS zc,
  CASE WHEN rk IS NOT NULL THEN greatest(0.001::DOUBLE, least(0.999::DOUBLE, rk)) END AS p FROM k),
y AS (SELECT *, (coalesce(z1, 0) + coalesce(z2, 0) + coalesce(z3, 0)) / nullif((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT, 0) AS trend FROM z),
x AS (SELECT *, 0.7::DOUBLE * ({positioning.normal_quantile('p')}) + 0.3::DOUBLE * zc AS net_score FROM y), w AS (SELECT series_id, dt, rn, rr, trend, net_score, (rr + trend + net_score) / 3 AS composite FROM x),
v AS {_rank('w', 'composite', WINDOW, int(WINDOW * 0.8), 'rk')}, s AS (SELECT series_id, dt, rr, trend, net_score, composite, (rk - 0.5) * 100 AS score FROM v)"""


def scores(spark, sf):
    b = bars(spark, sf).select("series_id", "dt", F.col("close").alias("spot"), F.col("iv").alias("rr_short"), roll(F.col("iv"), 6).alias("rr_long"), F.when(~(F.col("rn") % 11).between(5, 9), F.col("volume") - roll(F.col("volume"), 4)).alias("net"))
    return positioning.scores(b, WINDOW, LEVEL, CHANGE).select("series_id", "dt", "rr", "trend", "net_score", "composite", "score")


@query("bd4_positioning", f"{_SCORES} SELECT * FROM s", ["rr", "trend", "net_score", "composite", "score"])
def board(spark, sf):
    """BD4, BD4a-BD4d: the pillars of each series and their score."""
    return scores(spark, sf)


@query("bd4_positioning_against", f"{_SCORES} SELECT dt, -avg(score) AS score FROM s GROUP BY dt", ["score"])
def against(spark, sf):
    """BD4d: what all series are quoted against."""
    return positioning.against(scores(spark, sf))


@query("bd8_scorecard", f"""{_SCORES}, p AS (SELECT * FROM s {LAST}), t AS (SELECT series_id, dt, close, {S.z('close', 63)} AS z_63, (close / lag(close, 21) {S.W} - 1) * 100 AS roc_21, count(*) OVER (PARTITION BY series_id) AS n FROM b {LAST}),
c AS (SELECT series_id, dt, iv, iv - ({S.roll('r', 21, 'stddev_samp')}) * sqrt(252::DOUBLE) * 100 AS spread FROM b {LAST})
SELECT series_id, c.dt, t.close AS spot, t.z_63, t.roc_21, c.iv, c.spread, p.score FROM c LEFT JOIN (SELECT * FROM t WHERE n >= 60) t USING (series_id) LEFT JOIN p USING (series_id)""", ["spot", "z_63", "roc_21", "iv", "spread", "score"])  # fmt: skip
def scorecard(spark, sf):
    """BD8: the latest of the technical, carry and positioning boards, one row a series."""
    from tidemark.operators.rolling import realised_vol
    from tidemark.plans.boards import technical

    carry = last(bars(spark, sf).withColumn("spread", F.col("iv") - realised_vol(F.col("r"), 21)), ["iv", "spread"])
    held = technical(spark, sf).select("series_id", F.col("close").alias("spot"), F.col("zscore_3m").alias("z_63"), F.col("roc_1m").alias("roc_21"))
    placed = last(scores(spark, sf), ["score"]).drop("dt")
    return carry.join(held, "series_id", "left").join(placed, "series_id", "left").select("series_id", "dt", "spot", "z_63", "roc_21", "iv", "spread", "score")


_TECH = f"""{SPOT}, q AS (SELECT *, {S.z('px', 63)} AS z_63, (px / lag(px, 21) {S.W} - 1) * 100 AS roc_21 FROM spot {LAST}) SELECT base, quote, dt, px AS spot, z_63, roc_21 FROM q"""


@query("bd8_pair_scorecard", f"""SELECT c.base, c.quote, dt, t.spot, z_63, roc_21, rate_diff, real_carry, carry_vol_1m, vol_regime, pmi_diff, pmi_signal, bias_label, policy_diff
FROM ({BD2}) c LEFT JOIN ({BD3}) a USING (base, quote) LEFT JOIN ({_TECH}) t USING (base, quote)""", ["spot", "z_63", "roc_21", "rate_diff", "real_carry", "carry_vol_1m", "pmi_diff", "policy_diff"])  # fmt: skip
def pair_scorecard(spark, sf):
    """BD8: the carry, activity and technical boards of pairs side by side, with the latest spot."""
    from tidemark.plans.boards import last

    s = spots(spark, sf)
    s = s.withColumns({"z_63": zscore(F.col("px"), 63), "roc_21": (F.col("px") / lag(F.col("px"), 21) - 1) * 100})
    tech = last(s, ["base", "quote", F.col("px").alias("spot"), "z_63", "roc_21"]).drop("series_id")
    carry = carry_board(spark, sf).select("base", "quote", "rate_diff", "real_carry", "carry_vol_1m", "vol_regime")
    activity = activity_board(spark, sf).select("base", "quote", "pmi_diff", "pmi_signal", "bias_label", "policy_diff")
    return carry.join(activity, ["base", "quote"], "left").join(tech, ["base", "quote"], "left").select(
        "base", "quote", "dt", "spot", "z_63", "roc_21", "rate_diff", "real_carry", "carry_vol_1m", "vol_regime", "pmi_diff", "pmi_signal", "bias_label", "policy_diff"
    )
