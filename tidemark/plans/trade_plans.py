"""Queries over trades and regimes: trade logs, their metrics, attribution, blended signals, propagated states."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import indicators, rolling, state
from tidemark.operators.rolling import lag, roll
from tidemark.plans import sqltext as S
from tidemark.plans.boards import CRISIS_VOL, REGIMES, SOFT, is_crisis, prob_columns, signal_weights
from tidemark.plans.registry import query
from tidemark.plans.series_plans import B, _walk, bars
from tidemark.plans.vol_plans import MOMENTUM, dispersion_momentum

ENTER, COVER = 75, 55

_LOG = f"""{B}, d AS (SELECT *, close - lag(close) {S.W} AS d FROM b), m AS (SELECT series_id, dt, close, {S.roll('greatest(d, 0) + 0 * d', 14)} AS a, {S.roll('greatest(-d, 0) + 0 * d', 14)} AS c FROM d),
x AS (SELECT series_id, dt, close, CASE WHEN c > 0 THEN 100 - 100 / (1 + a / c) WHEN a > 0 THEN 100 END AS x FROM m),
k AS (SELECT *, sum((x < {COVER})::INT) {S.ALL} AS g FROM x WHERE x IS NOT NULL),
e AS (SELECT series_id, min(dt) AS entry_dt FROM k WHERE x > {ENTER} GROUP BY series_id, g),
o AS (SELECT e.series_id, entry_dt, min(CASE WHEN x < {COVER} THEN dt END) AS leave_dt, max(dt) AS last_dt FROM e JOIN k ON k.series_id = e.series_id AND k.dt >= entry_dt GROUP BY ALL),
t AS (SELECT o.series_id, entry_dt, p.close AS entry_price, q.dt AS exit_dt, q.close AS exit_price, leave_dt IS NULL AS still_open, (p.close - q.close) / p.close * 100 AS pnl_pct,
  (SELECT count(*) FROM k WHERE k.series_id = o.series_id AND k.dt > entry_dt AND k.dt <= q.dt) AS duration
  FROM o JOIN k p ON p.series_id = o.series_id AND p.dt = entry_dt JOIN k q ON q.series_id = o.series_id AND q.dt = coalesce(leave_dt, last_dt))"""


def trades(spark, sf):
    """Short when the RSI is above ENTER, covered below COVER; a trade that is still open is marked at the last row."""
    b = bars(spark, sf).withColumn("d", F.col("close") - lag(F.col("close"))).withColumn("x", indicators.rsi_simple())
    t = state.episodes(b, F.col("x"), ENTER, COVER)
    return t.withColumn("pnl_pct", (F.col("entry_price") - F.col("exit_price")) / F.col("entry_price") * 100)


_TRADE = ["series_id", "entry_dt", "entry_price", "exit_dt", "exit_price", "still_open", "pnl_pct", "duration"]


@query("st5_trade_log", f"{_LOG} SELECT {', '.join(_TRADE)} FROM t", ["entry_price", "exit_price", "pnl_pct"], ("entry_dt", "exit_dt"))
def trade_log(spark, sf):
    """ST5: one row per trade."""
    return trades(spark, sf).select(*_TRADE)


@query("ag10_trade_metrics", f"""{_LOG}, c AS (SELECT *, sum(pnl_pct) OVER w AS cum FROM t WHERE NOT still_open WINDOW w AS (PARTITION BY series_id ORDER BY exit_dt, entry_dt ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, cum - max(cum) OVER (PARTITION BY series_id ORDER BY exit_dt, entry_dt ROWS UNBOUNDED PRECEDING) AS dd FROM c)
SELECT series_id, count(*) AS n, avg((pnl_pct > 0)::INT) AS win_rate, avg(CASE WHEN pnl_pct > 0 THEN pnl_pct END) AS avg_win, avg(CASE WHEN pnl_pct <= 0 THEN pnl_pct END) AS avg_loss,
  sum(CASE WHEN pnl_pct > 0 THEN pnl_pct END) / nullif(-sum(CASE WHEN pnl_pct < 0 THEN pnl_pct END), 0) AS profit_factor,
  avg(pnl_pct) / nullif(stddev_samp(pnl_pct), 0) * sqrt(count(*) / nullif((max(exit_dt) - min(entry_dt)) / 365.25, 0)) AS ir, min(dd) AS max_dd,
  avg(CASE WHEN pnl_pct > 0 THEN duration END) AS win_duration, avg(CASE WHEN pnl_pct <= 0 THEN duration END) AS loss_duration FROM u GROUP BY series_id""",
    ["win_rate", "avg_win", "avg_loss", "profit_factor", "ir", "max_dd", "win_duration", "loss_duration"], ())
def trade_metrics(spark, sf):
    """AG10: statistics of closed trades."""
    w = W.partitionBy("series_id").orderBy("exit_dt", "entry_dt").rowsBetween(W.unboundedPreceding, 0)
    t = trades(spark, sf).filter("not still_open").withColumn("cum", F.sum("pnl_pct").over(w))
    t = t.withColumn("dd", F.col("cum") - F.max("cum").over(w))
    p, won = F.col("pnl_pct"), F.col("pnl_pct") > 0
    years = F.nullif(F.date_diff(F.max("exit_dt"), F.min("entry_dt")) / 365.25, F.lit(0.0))
    return t.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(won.cast("int")).alias("win_rate"), F.avg(F.when(won, p)).alias("avg_win"), F.avg(F.when(~won, p)).alias("avg_loss"),
        (F.sum(F.when(won, p)) / F.nullif(-F.sum(F.when(p < 0, p)), F.lit(0.0))).alias("profit_factor"), (F.avg(p) / F.nullif(F.stddev_samp(p), F.lit(0.0)) * F.sqrt(F.count(F.lit(1)) / years)).alias("ir"),
        F.min("dd").alias("max_dd"), F.avg(F.when(won, F.col("duration"))).alias("win_duration"), F.avg(F.when(~won, F.col("duration"))).alias("loss_duration"),
    )


@query("ag8_attribution", f"""{B}, s AS (SELECT series_id, dt, close - lag(close) {S.W} AS move, -sign({S.z('close', 60, 30)}) AS reversion, sign({S.z('volume', 52, 26)}) AS flow, CASE WHEN abs(r) > {S.roll('r', 20, 'stddev_samp')} THEN 'wild' ELSE 'calm' END AS regime FROM b),
h AS (SELECT series_id, component, regime, lag(signal) OVER (PARTITION BY series_id, component ORDER BY dt) * move AS pnl FROM (SELECT series_id, dt, move, regime, unnest(['reversion', 'flow']) AS component, unnest([reversion, flow]) AS signal FROM s))
SELECT series_id, component, regime, count(pnl) AS n, coalesce(sum(pnl), 0) AS pnl FROM h GROUP BY ALL""", ["pnl"], ())  # fmt: skip
def attribution(spark, sf):
    """AG8: one contract per component, held from the next row, by regime."""
    b = bars(spark, sf).select(
        "series_id", "dt", (F.col("close") - lag(F.col("close"))).alias("move"), (-F.signum(rolling.zscore(F.col("close"), 60, 30))).alias("reversion"), F.signum(rolling.zscore(F.col("volume"), 52, 26)).alias("flow"),
        F.when(F.abs("r") > roll(F.col("r"), 20, F.stddev_samp), "wild").otherwise("calm").alias("regime"),
    )
    long = b.unpivot(["series_id", "dt", "move", "regime"], ["reversion", "flow"], "component", "signal")
    w = W.partitionBy("series_id", "component").orderBy("dt")
    held = long.withColumn("pnl", F.lag("signal").over(w) * F.col("move"))
    return held.groupBy("series_id", "component", "regime").agg(F.count("pnl").alias("n"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"))


_PARTS = f""", {MOMENTUM}, mw AS (SELECT mo.*, b.rn, b.volume, (fast_mom + slow_mom) / 2 AS m FROM mo JOIN b USING (series_id, dt))"""
_ZM, _ZV = S.z("m", 26, 13), S.z("volume", 26, 13)


@query("st17_momentum", _walk(f"0.7::DOUBLE * ({_ZM}) + 0.3::DOUBLE * ({_ZV})", 1.2, 0.4, 1, _PARTS, "mw"), ["z"])
def momentum(spark, sf):
    """ST17: the z of the blended momentum, with the positions' z in the same window for 0.3 of it, then held with hysteresis."""
    b = dispersion_momentum(bars(spark, sf))
    b = b.withColumn("z", 0.7 * rolling.zscore(F.col("blended_mom"), 26, 13) + 0.3 * rolling.zscore(F.col("volume"), 26, 13))
    return state.hysteresis(b, F.col("z"), 1.2, 0.4, sign=1).select("series_id", "dt", "z", "position")


_TECH = [f"(({SOFT[k]}) / (({SOFT['mr']}) + ({SOFT['mom']})))" for k in ("mr", "mom")]
_ENSEMBLE = f""", {MOMENTUM}, {REGIMES}, zs AS (SELECT b.series_id, b.dt, b.rn, {S.z('close', 60, 30)} AS z_mr, {S.z('m', 26, 13)} AS z_mom FROM b JOIN (SELECT *, (fast_mom + slow_mom) / 2 AS m FROM mo) mo USING (series_id, dt)),
en AS (SELECT zs.*, {_TECH[0]} AS w_mr, {_TECH[1]} AS w_mom, coalesce(crisis > 0.6, false) OR coalesce(vol > {CRISIS_VOL}, false) AS is_crisis FROM zs LEFT JOIN n USING (series_id, dt))"""


@query("st8_ensemble", _walk("CASE WHEN is_crisis THEN 0 ELSE w_mr * z_mr + w_mom * z_mom END", 1.3, 0.5, 1, _ENSEMBLE, "en", "w_mr, w_mom, is_crisis"), ["z", "w_mr", "w_mom"])
def ensemble(spark, sf):
    """ST8: reversion and momentum blended by regime weights, nothing in a crisis (by probability or volatility), then held with hysteresis."""
    b = dispersion_momentum(prob_columns(bars(spark, sf)))
    w = signal_weights(news=False)
    b = b.withColumns({"z_mr": rolling.zscore(F.col("close"), 60, 30), "z_mom": rolling.zscore(F.col("blended_mom"), 26, 13), "w_mr": w["mr"], "w_mom": w["mom"], "is_crisis": is_crisis(vol=CRISIS_VOL)})
    b = b.withColumn("z", F.when(F.col("is_crisis"), 0.0).otherwise(F.col("w_mr") * F.col("z_mr") + F.col("w_mom") * F.col("z_mom")))
    return state.hysteresis(b, F.col("z"), 1.3, 0.5, sign=1).select("series_id", "dt", "z", "w_mr", "w_mom", "is_crisis", "position")


@query("st11_state_labels", f"""{B}, m AS (SELECT series_id, (month(dt) % 3)::INT AS state, stddev_samp(r) AS sigma FROM b GROUP BY ALL)
SELECT series_id, state, sigma, ['ranging', 'trending', 'crisis'][row_number() OVER (PARTITION BY series_id ORDER BY sigma, state)] AS label FROM m""", ["sigma"], ())  # fmt: skip
def labels(spark, sf):
    """ST11: states named by ascending volatility."""
    m = bars(spark, sf).groupBy("series_id", (F.month("dt") % 3).cast("int").alias("state")).agg(F.stddev_samp("r").alias("sigma"))
    names = F.array(*map(F.lit, ("ranging", "trending", "crisis")))
    return m.withColumn("label", F.element_at(names, F.row_number().over(W.partitionBy("series_id").orderBy("sigma", "state"))))


@query("st12_propagated_states", f"""{B.replace('WITH', 'WITH RECURSIVE', 1)}, s AS (SELECT series_id, (r > 0)::INT AS s, lag((r > 0)::INT) {S.W} AS s0 FROM b),
p AS (SELECT series_id, avg(CASE WHEN s0 = 1 THEN s END) AS up, avg(CASE WHEN s0 = 0 THEN s END) AS turn FROM s GROUP BY ALL),
w AS (SELECT series_id, up, turn, 1 AS step, up AS p_up FROM p UNION ALL SELECT series_id, up, turn, step + 1, greatest(0, least(1, p_up * up + (1 - p_up) * turn)) FROM w WHERE step < 21)
SELECT series_id, step, p_up FROM w""", ["p_up"], ())  # fmt: skip
def propagated(spark, sf):
    """ST12: the chance of an up state 1 to 21 steps after one, from each series' own transitions."""
    b = bars(spark, sf).withColumn("s", (F.col("r") > 0).cast("int")).withColumn("s0", lag(F.col("s")))
    p = b.groupBy("series_id").agg(F.avg(F.when(F.col("s0") == 1, F.col("s"))).alias("up"), F.avg(F.when(F.col("s0") == 0, F.col("s"))).alias("turn"))
    after = lambda n: F.aggregate(F.sequence(F.lit(1), n), F.lit(1.0), lambda x, _: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x * F.col("up") + (1 - x) * F.col("turn"))))
    return p.select("series_id", F.explode(F.sequence(F.lit(1), F.lit(21))).alias("step"), "up", "turn").select("series_id", "step", after(F.col("step")).alias("p_up"))


@query("bd6_squeeze_series", f"""{B}, v AS (SELECT series_id, dt, iv - ({S.roll('r', 20, 'stddev_samp')}) * sqrt(252::DOUBLE) * 100 AS spread, iv FROM b)
SELECT series_id, dt, spread, iv - lag(iv) {S.W} AS iv_chg, coalesce(spread < 0 AND iv - lag(iv) {S.W} > 0, false) AS squeeze FROM v""", ["spread", "iv_chg"])  # fmt: skip
def squeeze_series(spark, sf):
    """BD6: dates on which implied volatility rises from under the realised one."""
    b = bars(spark, sf).select("series_id", "dt", (F.col("iv") - rolling.realised_vol(F.col("r"), 20)).alias("spread"), (F.col("iv") - lag(F.col("iv"))).alias("iv_chg"))
    return b.withColumn("squeeze", F.coalesce((F.col("spread") < 0) & (F.col("iv_chg") > 0), F.lit(False)))
