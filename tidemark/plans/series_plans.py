"""Queries over bars: windows, indicators, volatility, states, statistics, joins in time."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import align, indicators, rolling, state, stats
from tidemark.operators.ewm import Mean, ewm, ewms, halflife, span
from tidemark.operators.rolling import lag, roll, series
from tidemark.plans import sqltext as S
from tidemark.plans.registry import query
from tidemark.sources import views

B = S.bars()


def bars(spark, sf, unit="week"):
    b = views.bars(spark, sf, unit)
    return b.withColumn("r", F.log(F.col("close") / lag(F.col("close")))).withColumn("rn", F.row_number().over(series()))


def simple(name, columns, unit="week"):
    """A query of window columns: {column: (Spark, SQL)}."""
    sql = S.bars(unit) + "\nSELECT series_id, dt, " + ", ".join(f"{q} AS {c}" for c, (_, q) in columns.items()) + " FROM b"

    @query(name, sql, list(columns))
    def run(spark, sf):
        return bars(spark, sf, unit).select("series_id", "dt", *(f().cast("double").alias(c) for c, (f, _) in columns.items()))


simple("pr2_returns", {"log_return": (lambda: F.col("r"), "r"), "price_change": (lambda: F.col("close") - lag(F.col("close")), f"close - lag(close) {S.W}")})
simple("wn1_zscore", {"z": (lambda: rolling.zscore(F.col("close"), 60, 30), S.z("close", 60, 30))})
simple("wn2_zscore_momentum", {"z": (lambda: rolling.zscore(F.col("volume"), 52, 26), S.z("volume", 52, 26))})
simple("wn3_zscore_strict", {"z": (lambda: rolling.zscore(F.col("close"), 180, 144), S.z("close", 180, 144))})
simple("wn4_zscore_filled", {"z": (lambda: F.coalesce(rolling.zscore(F.col("r"), 63, 10), F.lit(0.0)), f"coalesce({S.z('r', 63, 10)}, 0)")})
simple("wn7_zscore_90", {"z": (lambda: rolling.zscore(F.col("close"), 90), S.z("close", 90))})
simple("wn8_realised_vol", {f"rv_{n}": (lambda n=n: rolling.realised_vol(F.col("r"), n), f"({S.roll('r', n, 'stddev_samp')}) * sqrt(252::DOUBLE) * 100") for n in (20, 21, 63)})
simple("wn16_sma", {f"sma_{n}": (lambda n=n: roll(F.col("close"), n), S.roll("close", n)) for n in (20, 50, 200)})
simple("wn19_roc", {f"roc_{n}": (lambda n=n: (F.col("close") / lag(F.col("close"), n) - 1) * 100, f"(close / lag(close, {n}) {S.W} - 1) * 100") for n in (5, 21)})
simple("wn23_breakout", {"breakout": (lambda: F.when(lag(F.col("close"), 63).isNotNull(), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.log(F.col("close") / lag(F.col("close"), 63)) / F.nullif(roll(F.col("r"), 63, F.stddev_samp) * math.sqrt(63), F.lit(0.0)))) / 2),
    f"CASE WHEN lag(close, 63) {S.W} IS NOT NULL THEN greatest(-2, least(2, ln(close / lag(close, 63) {S.W}) / nullif(({S.roll('r', 63, 'stddev_samp')}) * sqrt(63::DOUBLE), 0))) / 2 END")})
simple("wn25_iv_bands", {f"band_{int(k * 10)}_{s}": (lambda k=k, g=g: F.col("close") * F.exp(g * k * F.col("iv") / 100 * math.sqrt(7 / 365)), f"close * exp({g * k!r}::DOUBLE * iv / 100 * sqrt(7 / 365::DOUBLE))") for k in (1.0, 1.5, 2.0) for s, g in (("up", 1), ("dn", -1))}
    | {"sigma_used": (lambda: F.abs(F.col("r")) / (lag(F.col("iv")) / 100 * math.sqrt(7 / 365)), f"abs(r) / (lag(iv) {S.W} / 100 * sqrt(7 / 365::DOUBLE))")})
simple("wn27_forward_mean", {"fwd": (lambda: rolling.forward_mean(F.col("r") * F.col("r") * 1e4, 5), "CASE WHEN count(r) OVER f = 5 THEN avg(r * r * 1e4) OVER f END")})
simple("wn29_changes", {f"chg_{n}": (lambda n=n: F.col("close") - lag(F.col("close"), n), f"close - lag(close, {n}) {S.W}") for n in (1, 20)} | {"pct_52": (lambda: (F.col("close") / lag(F.col("close"), 52) - 1) * 100, f"(close / lag(close, 52) {S.W} - 1) * 100")})
simple("wn31_drawdown", {"cum": (lambda: F.sum("r").over(state.running()), f"sum(r) {S.ALL}"), "peak": (lambda: F.max("close").over(state.running()), f"max(close) {S.ALL}"), "drawdown": (lambda: state.drawdown(F.col("close")), f"close - max(close) {S.ALL}")})
simple("wn34_iv_rv", {"ratio": (lambda: F.col("iv") / F.nullif(rolling.realised_vol(F.col("r"), 20), F.lit(0.0)), f"iv / nullif(({S.roll('r', 20, 'stddev_samp')}) * sqrt(252::DOUBLE) * 100, 0)"),
    "log_ratio": (lambda: F.log(F.col("iv") / F.nullif(rolling.realised_vol(F.col("r"), 20), F.lit(0.0))), f"ln(iv / nullif(({S.roll('r', 20, 'stddev_samp')}) * sqrt(252::DOUBLE) * 100, 0))"),
    "spread": (lambda: F.col("iv") - rolling.realised_vol(F.col("r"), 20), f"iv - ({S.roll('r', 20, 'stddev_samp')}) * sqrt(252::DOUBLE) * 100")})
simple("ag16_range_position", {"pos": (lambda: F.when(F.count("close").over(series().rowsBetween(-62, 0)) >= 5, F.coalesce((F.col("close") - F.min("close").over(series().rowsBetween(-62, 0))) / F.nullif(F.max("close").over(series().rowsBetween(-62, 0)) - F.min("close").over(series().rowsBetween(-62, 0)), F.lit(0.0)) * 100, F.lit(50.0))),
    f"CASE WHEN count(close) {S.frame(63)} >= 5 THEN coalesce((close - min(close) {S.frame(63)}) / nullif(max(close) {S.frame(63)} - min(close) {S.frame(63)}, 0) * 100, 50) END")})
simple("pr1_implied_rate", {"rate": (lambda: F.floor((100 - F.col("close") / 100) * 1e4 + 0.5) / 1e4, "floor((100 - close / 100) * 1e4 + 0.5) / 1e4")})
from tidemark.plans.registry import ORACLES  # noqa: E402

ORACLES["wn27_forward_mean"] = ORACLES["wn27_forward_mean"].replace(" FROM b) AS q", " FROM b WINDOW f AS (PARTITION BY series_id ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) AS q")

EST = "ln(high / low)", "ln(close / open)", "(ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open))"
K21 = 0.34 / (1.34 + 22 / 20)
LN2 = math.log(2)


def _vol(v: str) -> str:
    return f"sqrt(greatest({v}, 0) * 252) * 100"


@query("wn10_wn11_vol_estimators", f"""{B}, e AS (SELECT *, {EST[0]} AS hl, {EST[1]} AS co, {EST[2]} AS rs, ln(open / lag(close) {S.W}) AS gap FROM b),
v AS (SELECT series_id, dt, {S.roll('r', 21, 'stddev_samp')} AS cc, {S.roll('hl * hl', 21)} AS pk, {S.roll(f'(0.5 * hl * hl - {2 * LN2 - 1!r} * co * co)', 21)} AS gk, {S.roll('rs', 21)} AS rs,
  ({S.roll('gap', 21, 'var_samp')}) + {K21!r} * ({S.roll('co', 21, 'var_samp')}) + {1 - K21!r} * ({S.roll('rs', 21)}) AS yz FROM e)
SELECT series_id, dt, cc * sqrt(252::DOUBLE) * 100 AS vol_cc, CASE WHEN pk IS NOT NULL THEN {_vol(f'pk / {4 * LN2!r}')} END AS vol_parkinson, CASE WHEN gk IS NOT NULL THEN {_vol('gk')} END AS vol_gk,
  CASE WHEN rs IS NOT NULL THEN {_vol('rs')} END AS vol_rs, CASE WHEN yz IS NOT NULL THEN {_vol('yz')} END AS vol_yz FROM v""", ["vol_cc", "vol_parkinson", "vol_gk", "vol_rs", "vol_yz"])  # fmt: skip
def vol_estimators(spark, sf):
    b = bars(spark, sf).withColumn("gap", F.log(F.col("open") / lag(F.col("close"))))
    cols = indicators.estimators(21)
    has = {"vol_cc": F.col("r"), "vol_parkinson": F.col("close"), "vol_gk": F.col("close"), "vol_rs": F.col("close")}
    return b.select("series_id", "dt", *(F.when(F.count(has[k]).over(series().rowsBetween(-20, 0)) >= 21, v).alias(k) if k in has else v.alias(k) for k, v in cols.items()))


@query("wn9_autocorrelation", f"{B}, p AS (SELECT *, lag(r) {S.W} AS r1 FROM b) SELECT series_id, dt, CASE WHEN count(CASE WHEN r1 IS NOT NULL THEN r END) {S.frame(19)} >= 19 THEN corr(r, r1) {S.frame(19)} END AS autocorr FROM p", ["autocorr"])
def autocorrelation(spark, sf):
    b = bars(spark, sf).withColumn("r1", lag(F.col("r")))
    return b.select("series_id", "dt", rolling.autocorr(F.col("r"), F.col("r1"), 20).alias("autocorr"))


@query("wn16_bollinger", f"{B}, m AS (SELECT series_id, dt, close, {S.roll('close', 20)} AS m, {S.roll('close', 20, 'stddev_samp')} AS s FROM b) SELECT series_id, dt, m AS bb_mid, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, (close - (m - 2 * s)) / nullif(4 * s, 0) AS bb_pct, 4 * s / m AS bb_width FROM m", ["bb_mid", "bb_upper", "bb_lower", "bb_pct", "bb_width"])
def bollinger(spark, sf):
    return bars(spark, sf).select("series_id", "dt", *(v.alias(k) for k, v in indicators.bollinger().items()))


@query("wn17_squeeze", f"""{B}, m AS (SELECT series_id, dt, rn, 4 * ({S.roll('close', 20, 'stddev_samp')}) / ({S.roll('close', 20)}) AS w FROM b),
k AS (SELECT c.series_id, c.dt, c.w, (sum(CASE WHEN p.w < c.w THEN 1 ELSE 0 END) + (sum(CASE WHEN p.w = c.w THEN 1 ELSE 0 END) + 1) / 2.0) / count(p.w) * 100 AS pct FROM m c JOIN m p ON p.series_id = c.series_id AND p.rn <= c.rn AND c.w IS NOT NULL GROUP BY ALL)
SELECT m.series_id, m.dt, m.w AS bb_width, pct AS width_pct, coalesce(pct <= 20, false) AS squeeze FROM m LEFT JOIN k USING (series_id, dt)""", ["bb_width", "width_pct"])  # fmt: skip
def squeeze(spark, sf):
    """WN17, WN20d: the band's width and its rank among all widths so far."""
    b = bars(spark, sf).withColumn("bb_width", indicators.bollinger()["bb_width"])
    b = rolling.expanding_rank(b, "bb_width", "width_pct").withColumn("width_pct", F.col("width_pct") * 100)
    return b.select("series_id", "dt", "bb_width", "width_pct", F.coalesce(F.col("width_pct") <= 20, F.lit(False)).alias("squeeze"))


@query("wn20_rolling_ranks", f"""{B}, k AS (SELECT c.series_id, c.dt, c.rn, (sum((p.close < c.close)::INT) + (sum((p.close = c.close)::INT) + 1) / 2.0) / count(*) AS pct,
  CASE WHEN count(*) = 52 THEN 100.0 * sum((p.close < c.close)::INT) / 51 END AS below FROM b c JOIN b p ON p.series_id = c.series_id AND p.rn BETWEEN c.rn - 51 AND c.rn GROUP BY ALL)
SELECT series_id, dt, CASE WHEN rn >= 52 THEN pct END AS rank_pct, below AS rank_below FROM k""", ["rank_pct", "rank_below"])  # fmt: skip
def ranks(spark, sf):
    b = rolling.rolling_rank(bars(spark, sf).select("series_id", "dt", "close"), "close", 52, "rank_pct", 52)
    return rolling.rolling_rank(b, "close", 52, "rank_below", 51, below=True).drop("close")


@query("wn12_ewma_vol", f"{B}, x AS (SELECT series_id, dt, r * r AS x, row_number() {S.W} AS rn FROM b WHERE r IS NOT NULL), e AS {S.ewm('x', 'x', 'v', 1 - 0.94, False)} SELECT series_id, dt, sqrt(v * 252) * 100 AS ewma_vol FROM e", ["ewma_vol"])
def ewma_vol(spark, sf):
    b = bars(spark, sf).filter("r is not null")
    return ewm(b, F.col("r") * F.col("r"), "v", 1 - 0.94, adjust=False).select("series_id", "dt", (F.sqrt(F.col("v") * 252) * 100).alias("ewma_vol"))


@query("wn13_ewm_means", f"{B}, a AS {S.ewm('b', 'r', 'trend', halflife(10), True, 10)}, s AS {S.ewm('b', 'close', 'ema', span(12), False)} SELECT a.series_id, a.dt, trend, ema FROM a JOIN s USING (series_id, dt)", ["trend", "ema"])
def ewm_means(spark, sf):
    means = {"trend": Mean(F.col("r"), halflife(10), True, 10), "ema": Mean(F.col("close"), span(12), False)}
    return ewms(bars(spark, sf), means).select("series_id", "dt", "trend", "ema")


def _rsi_sql(adjust: bool) -> str:
    return f"""{B}, d AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS l FROM (SELECT *, close - lag(close) {S.W} AS d FROM b)),
g AS {S.ewm('d', 'u', 'g', 1 / 14, adjust)}, s AS {S.ewm('d', 'l', 's', 1 / 14, adjust)}"""


@query("wn14_rsi", f"""{_rsi_sql(True)}, q AS (SELECT series_id, dt, {S.roll('u', 14)} AS a, {S.roll('l', 14)} AS c FROM d), g2 AS {S.ewm('d', 'u', 'g2', 1 / 14, False)}, s2 AS {S.ewm('d', 'l', 's2', 1 / 14, False)}
SELECT g.series_id, g.dt, 100 - 100 / (1 + g / nullif(s, 0)) AS rsi_ewm, 100 - 100 / (1 + g2 / nullif(s2, 0)) AS rsi_wilder, CASE WHEN c > 0 THEN 100 - 100 / (1 + a / c) WHEN a > 0 THEN 100 END AS rsi_simple
FROM g JOIN s USING (series_id, dt) JOIN q USING (series_id, dt) JOIN g2 USING (series_id, dt) JOIN s2 USING (series_id, dt)""", ["rsi_ewm", "rsi_wilder", "rsi_simple"])  # fmt: skip
def rsi(spark, sf):
    b = indicators.rsis(bars(spark, sf), {"rsi_ewm": True, "rsi_wilder": False}).withColumn("d", F.col("close") - lag(F.col("close")))
    return b.select("series_id", "dt", "rsi_ewm", "rsi_wilder", indicators.rsi_simple().alias("rsi_simple"))


@query("wn15_macd", f"""{B}, f AS {S.ewm('b', 'close', 'f', span(12), False)}, s AS {S.ewm('b', 'close', 's', span(26), False)},
m AS (SELECT series_id, dt, f - s AS macd, row_number() {S.W} AS rn FROM f JOIN s USING (series_id, dt)), g AS {S.ewm('m', 'macd', 'macd_signal', span(9), False)}
SELECT series_id, dt, macd, macd_signal, macd - macd_signal AS macd_hist FROM m JOIN g USING (series_id, dt)""", ["macd", "macd_signal", "macd_hist"])  # fmt: skip
def macd(spark, sf):
    return indicators.macd(bars(spark, sf)).select("series_id", "dt", "macd", "macd_signal", "macd_hist")


@query("wn18_adx", f"""{B}, a AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) {S.W}), 0), coalesce(abs(low - lag(close) {S.W}), 0)) AS tr, high - lag(high) {S.W} AS du, lag(low) {S.W} - low AS dd FROM b),
d AS (SELECT *, CASE WHEN du IS NULL THEN NULL WHEN greatest(du, 0) > greatest(dd, 0) THEN greatest(du, 0) ELSE 0 END AS p FROM a), e AS (SELECT *, CASE WHEN dd IS NULL THEN NULL WHEN greatest(dd, 0) > p THEN greatest(dd, 0) ELSE 0 END AS m FROM d),
t1 AS {S.ewm('e', 'tr', 'atr', 1 / 14)}, t2 AS {S.ewm('e', 'p', 'ps', 1 / 14)}, t3 AS {S.ewm('e', 'm', 'ms', 1 / 14)},
i AS (SELECT series_id, dt, 100 * ps / nullif(atr, 0) AS pd, 100 * ms / nullif(atr, 0) AS md FROM t1 JOIN t2 USING (series_id, dt) JOIN t3 USING (series_id, dt)),
x AS (SELECT *, 100 * abs(pd - md) / nullif(pd + md, 0) AS dx, row_number() {S.W} AS rn FROM i), y AS {S.ewm('x', 'dx', 'adx', 1 / 14)} SELECT series_id, dt, adx FROM y""", ["adx"])  # fmt: skip
def adx(spark, sf):
    return indicators.adx(bars(spark, sf)).select("series_id", "dt", "adx")


def _walk(z: str, entry: float, leave: float, sign: int, more: str = "", src: str = "b", keep: str = "") -> str:
    """Positions by a recursive walk, row after row; `more`: CTEs after the bars, of which `src` has rn, what z needs and what is kept."""
    return f"""{B.replace('WITH', 'WITH RECURSIVE', 1)}{more}, s AS (SELECT series_id, dt, rn, {z} AS z FROM {src}),
p AS (SELECT series_id, dt, rn, z, CASE WHEN z > {entry} THEN {sign} WHEN z < -{entry} THEN -({sign}) ELSE 0 END AS state FROM s WHERE rn = 1
  UNION ALL SELECT s.series_id, s.dt, s.rn, s.z, CASE WHEN s.z IS NULL THEN p.state WHEN p.state = 0 AND s.z > {entry} THEN {sign} WHEN p.state = 0 AND s.z < -{entry} THEN -({sign}) WHEN p.state <> 0 AND abs(s.z) < {leave} THEN 0 ELSE p.state END
  FROM p JOIN s ON s.series_id = p.series_id AND s.rn = p.rn + 1)
SELECT p.series_id, p.dt, p.z{keep and ', ' + keep}, CASE WHEN p.z IS NULL THEN 0 ELSE state END AS position FROM p{f' JOIN {src} ON {src}.series_id = p.series_id AND {src}.rn = p.rn' if keep else ''}"""


@query("st1_reversion_position", _walk(S.z("close", 60, 30), 1.5, 0.5, -1), ["z"])
def reversion(spark, sf):
    b = bars(spark, sf).withColumn("z", rolling.zscore(F.col("close"), 60, 30))
    return state.hysteresis(b, F.col("z"), 1.5, 0.5).select("series_id", "dt", "z", "position")


@query("st2_trend_position", _walk(S.z("close", 26, 13), 1.2, 0.4, 1), ["z"])
def trend(spark, sf):
    b = bars(spark, sf).withColumn("z", rolling.zscore(F.col("close"), 26, 13))
    return state.hysteresis(b, F.col("z"), 1.2, 0.4, sign=1).select("series_id", "dt", "z", "position")


@query("st3_news_position", _walk(f"coalesce({S.z('r', 63, 10)}, 0)", 1.0, 0.3, 1), ["z"])
def filled(spark, sf):
    b = bars(spark, sf).withColumn("z", F.coalesce(rolling.zscore(F.col("r"), 63, 10), F.lit(0.0)))
    return state.hysteresis(b, F.col("z"), 1.0, 0.3, sign=1).select("series_id", "dt", "z", "position")


@query("st4_threshold_strategy", f"""{B}, s AS (SELECT *, CASE WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 WHEN z IS NOT NULL THEN 0 END AS sig FROM (SELECT *, {S.z('close', 90)} AS z FROM b)),
p AS (SELECT *, lag(sig) {S.W} * r AS pnl, lag(sig) {S.W} AS pos FROM s), c AS (SELECT *, sum(pnl) {S.ALL} AS cum FROM p), d AS (SELECT *, cum - max(cum) {S.ALL} AS dd FROM c)
SELECT series_id, sum(pnl) AS total, avg(pnl) * 252 AS ann_ret, stddev_samp(pnl) * sqrt(252::DOUBLE) AS ann_vol, avg(pnl) * 252 / nullif(stddev_samp(pnl) * sqrt(252::DOUBLE), 0) AS sharpe, min(dd) AS max_dd,
  avg(CASE WHEN pos <> 0 THEN (pnl > 0)::INT END) AS hit_rate FROM d GROUP BY series_id""", ["total", "ann_ret", "ann_vol", "sharpe", "max_dd", "hit_rate"], ())  # fmt: skip
def threshold(spark, sf):
    """AG9: the z-score strategy's statistics per series."""
    z = F.col("z")
    b = bars(spark, sf).withColumn("z", rolling.zscore(F.col("close"), 90)).withColumn("sig", F.when(z > 1, -1).when(z < -1, 1).when(z.isNotNull(), 0))
    b = b.withColumn("pos", lag(F.col("sig"))).withColumn("pnl", F.col("pos") * F.col("r")).withColumn("cum", F.sum("pnl").over(state.running()))
    b = b.withColumn("dd", state.drawdown(F.col("cum")))
    vol = F.stddev_samp("pnl") * math.sqrt(252)
    return b.groupBy("series_id").agg(F.sum("pnl").alias("total"), (F.avg("pnl") * 252).alias("ann_ret"), vol.alias("ann_vol"), (F.avg("pnl") * 252 / F.nullif(vol, F.lit(0.0))).alias("sharpe"), F.min("dd").alias("max_dd"), F.avg(F.when(F.col("pos") != 0, (F.col("pnl") > 0).cast("int"))).alias("hit_rate"))


@query("wn32_longest_underwater", f"""{B}, d AS (SELECT series_id, rn, close < max(close) {S.ALL} AS f FROM b), g AS (SELECT series_id, f, rn - row_number() OVER (PARTITION BY series_id, f ORDER BY rn) AS g FROM d)
SELECT series_id, coalesce(max(CASE WHEN f THEN n END), 0)::BIGINT AS longest FROM (SELECT series_id, f, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY series_id""", (), ())  # fmt: skip
def underwater(spark, sf):
    return state.longest_run(bars(spark, sf).withColumn("f", F.col("close") < F.max("close").over(state.running())), F.col("f"))


@query("ag3_ou_fit", f"""{B}, p AS (SELECT series_id, close - lag(close) {S.W} AS y, lag(close) {S.W} AS x FROM b), f AS (SELECT * FROM p WHERE x IS NOT NULL),
m AS (SELECT series_id, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM f GROUP BY series_id),
s AS (SELECT series_id, n, mx, my, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy FROM f JOIN m USING (series_id) GROUP BY ALL)
SELECT series_id, n, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept, sxy * sxy / (sxx * syy) AS r2, sqrt((syy - sxy * sxy / sxx) / (n - 1)) AS resid_std, (sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t_stat,
  {S.t_p_value('(sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)', 'n - 2')} AS p_value, sxy < 0 AND {S.t_p_value('(sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)', 'n - 2')} < 0.10 AS reverts,
  -(sxy / sxx) * 252 AS kappa, -(my - sxy / sxx * mx) / (sxy / sxx) AS mu, CASE WHEN sxy < 0 THEN ln(2) / -(sxy / sxx) END AS half_life FROM s WHERE n >= 30""", ["slope", "intercept", "r2", "resid_std", "t_stat", "p_value", "kappa", "mu", "half_life"], ())  # fmt: skip
def ou_fit(spark, sf):
    """OU parameters from the regression of changes on levels, one aggregate per series."""
    p = bars(spark, sf).select("series_id", (F.col("close") - lag(F.col("close"))).alias("y"), lag(F.col("close")).alias("x")).filter("x is not null")
    s = p.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy")).filter("n >= 30")
    sse = F.col("syy") - F.col("slope") * F.col("sxy")
    b = F.col("slope")
    s = s.withColumn("t_stat", b / F.sqrt(sse / (F.col("n") - 2) / F.col("sxx"))).withColumn("p_value", stats.t_p_value(F.col("t_stat"), F.col("n") - 2))
    reverts = ((b < 0) & (F.col("p_value") < 0.10)).alias("reverts")
    return s.select("series_id", "n", "slope", "intercept", "r2", F.sqrt(sse / (F.col("n") - 1)).alias("resid_std"), "t_stat", "p_value", reverts, (-b * 252).alias("kappa"), (-F.col("intercept") / b).alias("mu"), F.when(b < 0, math.log(2) / -b).alias("half_life"))


@query("ag6_trend", f"""{B}, y AS (SELECT series_id, year(dt) AS y, avg(close) AS v FROM b GROUP BY ALL), c AS (SELECT *, v / lag(v) OVER (PARTITION BY series_id ORDER BY y) - 1 AS g FROM y)
SELECT series_id, regr_slope(v, y) AS slope, pow(arg_max(v, y) / arg_min(v, y), 1.0 / (max(y) - min(y))) - 1 AS cagr, avg(g) AS mean_yoy FROM c GROUP BY series_id""", ["slope", "cagr", "mean_yoy"], ())  # fmt: skip
def trend_fit(spark, sf):
    """AG2, AG6: yearly means, their slope, CAGR and mean growth."""
    y = bars(spark, sf).groupBy("series_id", F.year("dt").alias("y")).agg(F.avg("close").alias("v"))
    y = y.withColumn("g", F.col("v") / F.lag("v").over(W.partitionBy("series_id").orderBy("y")) - 1)
    return y.groupBy("series_id").agg(F.regr_slope("v", "y").alias("slope"), (F.pow(F.max_by("v", "y") / F.min_by("v", "y"), 1.0 / (F.max("y") - F.min("y"))) - 1).alias("cagr"), F.avg("g").alias("mean_yoy"))


@query("ag1_intraday_rv", """WITH t AS (SELECT event_type AS series_id, ts, ln(nullif(value, 0) / nullif(lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0)) AS r FROM events)
SELECT series_id, ts::DATE AS dt, sqrt(sum(r * r) * 252) * 100 AS rv, count(r) AS n FROM t GROUP BY ALL""", ["rv"])  # fmt: skip
def intraday(spark, sf):
    w = W.partitionBy("series_id").orderBy("ts", "event_id")
    t = views.ticks(spark, sf).withColumn("r", F.log(F.nullif(F.col("price"), F.lit(0.0)) / F.nullif(F.lag("price").over(w), F.lit(0.0))))
    return t.groupBy("series_id", F.to_date("ts").alias("dt")).agg((F.sqrt(F.sum(F.col("r") * F.col("r")) * 252) * 100).alias("rv"), F.count("r").alias("n"))


@query("jn4_asof_join", """WITH m AS (SELECT o_orderpriority AS name, date_trunc('month', o_orderdate)::DATE AS dt, avg(o_totalprice) AS value FROM orders GROUP BY ALL),
d AS (SELECT o_orderkey, o_orderpriority AS name, (o_orderdate::DATE - 40) AS dt FROM orders)
SELECT o_orderkey, d.name, d.dt, m.value FROM d ASOF LEFT JOIN m ON d.name = m.name AND d.dt >= m.dt""", ["value"])  # fmt: skip
def asof(spark, sf):
    """The last monthly value known forty days before each order."""
    left = views.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), F.date_sub(F.to_date("o_orderdate"), 40).alias("dt"))
    return align.asof(left, views.monthly(spark, sf), ["name"], "dt", "value")


D = S.bars("day")
SPINE = f"""{D}, e AS (SELECT series_id, min(dt) AS a, max(dt) AS z FROM b GROUP BY series_id), s AS (SELECT series_id, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS dt FROM e),
j AS (SELECT s.series_id, s.dt, close FROM s LEFT JOIN b USING (series_id, dt) WHERE isodow(s.dt) < 6)"""


@query("fr1_fr2_business_spine", f"{SPINE} SELECT series_id, dt, close, last_value(close IGNORE NULLS) {S.ALL} AS carried, last_value(close IGNORE NULLS) {S.frame(3)} AS carried_2 FROM j", ["close", "carried", "carried_2"])
def spine(spark, sf):
    """FR1, FR2, JN3, WN28: daily bars on business days, carried without a cap and over two rows at most."""
    b = views.bars(spark, sf, "day").select("series_id", "dt", "close")
    ends = b.groupBy("series_id").agg(F.min("dt").alias("a"), F.max("dt").alias("z"))
    rows = align.business_days(ends, "a", "z").select("series_id", "dt").join(b, ["series_id", "dt"], "left")
    return rows.select("series_id", "dt", "close", rolling.fill(F.col("close")).alias("carried"), rolling.fill(F.col("close"), 2).alias("carried_2"))


FOLDS = f"""f AS (SELECT series_id, n, fold, 52 + fold * 26 AS pos FROM (SELECT series_id, max(rn) AS n FROM b GROUP BY ALL), LATERAL (SELECT unnest(range(0, greatest(0, (n - 26 - 52) // 26 + 1))) AS fold))"""


@query("jn12_walk_forward_folds", f"{B}, {FOLDS} SELECT f.series_id, fold, sum((rn - 1 < pos)::INT)::BIGINT AS n_train, sum((rn - 1 >= pos)::INT)::BIGINT AS n_test, avg(CASE WHEN rn - 1 < pos THEN close END) AS train_mean FROM f JOIN b ON b.series_id = f.series_id AND rn - 1 >= pos - 104 AND rn - 1 < pos + 26 GROUP BY ALL", ["train_mean"], ())
def folds(spark, sf):
    """JN12: train 104 (52 at least), test 26, step 26 rows; statistics of each fold."""
    f = align.folds(bars(spark, sf).drop("rn"), 104, 26, 26, 52)
    train = F.col("part") == "train"
    return f.groupBy("series_id", "fold").agg(F.count(F.when(train, 1)).alias("n_train"), F.count(F.when(~train, 1)).alias("n_test"), F.avg(F.when(train, F.col("close"))).alias("train_mean"))
