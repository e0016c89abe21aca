"""Assembled boards and backtests."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import hot, indicators, rolling, state
from tidemark.operators.ewm import span
from tidemark.operators.rolling import lag, roll, series
from tidemark.plans import sqltext as S
from tidemark.plans.registry import query
from tidemark.plans.series_plans import B, bars
from tidemark.sources import views

LAST = "QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY dt DESC) = 1"


def last(df, keep):
    w = W.partitionBy("series_id").orderBy(F.desc("dt"))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("series_id", "dt", *keep)


BOARD = ["rsi_14", "rsi_zone", "macd_signal", "macd_hist", "sma_20_50", "sma_50_200", "roc_1m", "roc_3m", "bb_pct_b", "adx_14", "adx_strength", "zscore_1m", "zscore_3m", "zscore_1y"]
_CROSS = lambda f, s: f"CASE WHEN {f} IS NULL OR {s} IS NULL THEN 'N/A' WHEN {f} > {s} THEN 'Bull' WHEN {f} < {s} THEN 'Bear' ELSE 'Flat' END"
_ZONE = lambda x: f"CASE WHEN {x} IS NULL THEN 'N/A' WHEN {x} >= 70 THEN 'Overbought' WHEN {x} <= 30 THEN 'Oversold' ELSE 'Neutral' END"


@query("bd1_technical_board", f"""{B}, d AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS l FROM (SELECT *, close - lag(close) {S.W} AS d FROM b)),
g AS {S.ewm('d', 'u', 'g', 1 / 14, True, 14)}, s AS {S.ewm('d', 'l', 's', 1 / 14, True, 14)}, rs AS (SELECT series_id, dt, 100 - 100 / (1 + g / nullif(s, 0)) AS rsi_14 FROM g JOIN s USING (series_id, dt)),
ef AS {S.ewm('b', 'close', 'f', span(12), False)}, es AS {S.ewm('b', 'close', 's', span(26), False)}, mc AS (SELECT series_id, dt, f - s AS macd, row_number() {S.W} AS rn FROM ef JOIN es USING (series_id, dt)),
sg AS {S.ewm('mc', 'macd', 'sig', span(9), False)}, hi AS (SELECT series_id, dt, macd - sig AS h FROM mc JOIN sg USING (series_id, dt)), hb AS (SELECT *, lag(h) {S.W} AS h0 FROM hi),
a AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) {S.W}), 0), coalesce(abs(low - lag(close) {S.W}), 0)) AS tr, high - lag(high) {S.W} AS du, lag(low) {S.W} - low AS dd FROM b),
dp AS (SELECT *, CASE WHEN du IS NULL THEN NULL WHEN greatest(du, 0) > greatest(dd, 0) THEN greatest(du, 0) ELSE 0 END AS p FROM a), dm AS (SELECT *, CASE WHEN dd IS NULL THEN NULL WHEN greatest(dd, 0) > p THEN greatest(dd, 0) ELSE 0 END AS m FROM dp),
t1 AS {S.ewm('dm', 'tr', 'atr', 1 / 14, True, 14)}, t2 AS {S.ewm('dm', 'p', 'ps', 1 / 14, True, 14)}, t3 AS {S.ewm('dm', 'm', 'ms', 1 / 14, True, 14)},
di AS (SELECT series_id, dt, 100 * ps / nullif(atr, 0) AS pd, 100 * ms / nullif(atr, 0) AS md FROM t1 JOIN t2 USING (series_id, dt) JOIN t3 USING (series_id, dt)),
dx AS (SELECT *, 100 * abs(pd - md) / nullif(pd + md, 0) AS dx, row_number() {S.W} AS rn FROM di), ax AS {S.ewm('dx', 'dx', 'adx_14', 1 / 14, True, 14)},
w AS (SELECT series_id, dt, close, {S.roll('close', 20)} AS s20, {S.roll('close', 50)} AS s50, {S.roll('close', 200)} AS s200, {S.roll('close', 20, 'stddev_samp')} AS sd, (close / nullif(lag(close, 21) {S.W}, 0) - 1) * 100 AS roc_1m, (close / nullif(lag(close, 63) {S.W}, 0) - 1) * 100 AS roc_3m,
  {S.z('close', 21)} AS zscore_1m, {S.z('close', 63)} AS zscore_3m, {S.z('close', 252)} AS zscore_1y, count(*) OVER (PARTITION BY series_id) AS n FROM b)
SELECT w.series_id, w.dt, close, rsi_14, {_ZONE('rsi_14')} AS rsi_zone, CASE WHEN h IS NULL OR h0 IS NULL THEN 'N/A' WHEN h > 0 AND h > h0 THEN 'Bullish ' || chr(8593) WHEN h < 0 AND h < h0 THEN 'Bearish ' || chr(8595) WHEN h > 0 THEN 'Bullish ~' WHEN h < 0 THEN 'Bearish ~' ELSE 'Neutral' END AS macd_signal,
  h AS macd_hist, {_CROSS('s20', 's50')} AS sma_20_50, {_CROSS('s50', 's200')} AS sma_50_200, roc_1m, roc_3m, (close - (s20 - 2 * sd)) / nullif(4 * sd, 0) AS bb_pct_b, adx_14,
  CASE WHEN adx_14 IS NULL THEN 'N/A' WHEN adx_14 >= 40 THEN 'Strong' WHEN adx_14 >= 25 THEN 'Trending' ELSE 'Weak' END AS adx_strength, zscore_1m, zscore_3m, zscore_1y
FROM w JOIN rs USING (series_id, dt) JOIN hb USING (series_id, dt) JOIN ax USING (series_id, dt) WHERE n >= 60 QUALIFY row_number() OVER (PARTITION BY w.series_id ORDER BY w.dt DESC) = 1""",
    ["close", "rsi_14", "macd_hist", "roc_1m", "roc_3m", "bb_pct_b", "adx_14", "zscore_1m", "zscore_3m", "zscore_1y"])
def technical(spark, sf):
    """BD1: the latest indicators of each series with 60 rows or more."""
    b = indicators.technical(bars(spark, sf).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("series_id"))))
    return last(b.filter("n >= 60"), ["close", *BOARD])


@query("pr5_pr6_labels", f"""{B}, d AS (SELECT *, close - lag(close) {S.W} AS d FROM b), m AS (SELECT series_id, dt, {S.roll('greatest(d, 0) + 0 * d', 14)} AS a, {S.roll('greatest(-d, 0) + 0 * d', 14)} AS c, {S.roll('close', 20)} AS f, {S.roll('close', 50)} AS s FROM d),
x AS (SELECT *, CASE WHEN c > 0 THEN 100 - 100 / (1 + a / c) WHEN a > 0 THEN 100 END AS x FROM m) SELECT series_id, dt, x AS rsi, {_ZONE('x')} AS zone, {_CROSS('f', 's')} AS cross_label FROM x""", ["rsi"])  # fmt: skip
def labels(spark, sf):
    """PR5, PR6: zones and crosses at every row."""
    b = bars(spark, sf).withColumn("d", F.col("close") - lag(F.col("close"))).withColumn("rsi", indicators.rsi_simple())
    return b.select("series_id", "dt", "rsi", indicators.rsi_zone(F.col("rsi")).alias("zone"), indicators.cross_label(roll(F.col("close"), 20), roll(F.col("close"), 50)).alias("cross_label"))


_STRATEGY = f"""{B.replace('WITH', 'WITH RECURSIVE', 1)}, s AS (SELECT series_id, dt, rn, close, r, {S.z('close', 60, 30)} AS z FROM b),
p AS (SELECT series_id, dt, rn, close, r, z, CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 ELSE 0 END AS state FROM s WHERE rn = 1
  UNION ALL SELECT s.series_id, s.dt, s.rn, s.close, s.r, s.z, CASE WHEN s.z IS NULL THEN p.state WHEN p.state = 0 AND s.z > 1.5 THEN -1 WHEN p.state = 0 AND s.z < -1.5 THEN 1 WHEN p.state <> 0 AND abs(s.z) < 0.5 THEN 0 ELSE p.state END
  FROM p JOIN s ON s.series_id = p.series_id AND s.rn = p.rn + 1),
q AS (SELECT *, CASE WHEN z IS NULL THEN 0 ELSE state END AS position FROM p),
h AS (SELECT *, coalesce(lag(position) {S.W}, 0) AS held, {S.roll('r', 20, 'stddev_samp', 5)} AS sigma FROM q),
t AS (SELECT *, CASE WHEN held = 0 OR sigma IS NULL THEN 0 ELSE held * greatest(1, least(10, floor(0.1 / nullif(sigma, 0) + 0.5))) END AS contracts FROM h),
n AS (SELECT *, contracts * (close - lag(close) {S.W}) AS gross, abs(contracts - coalesce(lag(contracts) {S.W}, 0)) * 2.5 AS cost FROM t),
d AS (SELECT series_id, dt, held, contracts, coalesce(gross, 0) AS gross, cost, coalesce(gross, 0) - cost AS net FROM n)"""


def strategy(spark, sf):
    """Reversion positions, held from the next row, in volatility-targeted contracts, with costs on changes."""
    b = bars(spark, sf).withColumn("z", rolling.zscore(F.col("close"), 60, 30))
    b = state.hysteresis(b, F.col("z"), 1.5, 0.5)
    b = b.withColumn("held", F.coalesce(lag(F.col("position")), F.lit(0))).withColumn("sigma", roll(F.col("r"), 20, F.stddev_samp, 5))
    size = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(0.1 / F.nullif(F.col("sigma"), F.lit(0.0)) + 0.5)))
    b = b.withColumn("contracts", F.when((F.col("held") == 0) | F.col("sigma").isNull(), 0).otherwise(F.col("held") * size).cast("double"))
    b = b.withColumn("gross", F.coalesce(F.col("contracts") * (F.col("close") - lag(F.col("close"))), F.lit(0.0))).withColumn("cost", F.abs(F.col("contracts") - F.coalesce(lag(F.col("contracts")), F.lit(0.0))) * 2.5)
    return b.withColumn("net", F.col("gross") - F.col("cost"))


@query("st6_daily_pnl", f"{_STRATEGY} SELECT series_id, dt, held, contracts::DOUBLE AS contracts, gross, cost, net, sum(net) {S.ALL} AS cum FROM d", ["contracts", "gross", "cost", "net", "cum"])
def pnl(spark, sf):
    return strategy(spark, sf).select("series_id", "dt", "held", "contracts", "gross", "cost", "net", F.sum("net").over(state.running()).alias("cum"))


_METRICS = ["total", "ann", "vol", "sharpe", "sortino", "max_dd", "calmar", "win_rate", "avg_win", "avg_loss", "profit_factor"]


@query("ag7_performance", f"""{_STRATEGY}, c AS (SELECT *, sum(net) {S.ALL} AS cum FROM d), e AS (SELECT *, cum - max(cum) {S.ALL} AS dd, row_number() {S.W} AS i FROM c),
u AS (SELECT series_id, dd < 0 AS f, i - row_number() OVER (PARTITION BY series_id, dd < 0 ORDER BY dt) AS g FROM e), l AS (SELECT series_id, coalesce(max(CASE WHEN f THEN k END), 0)::BIGINT AS longest_dd FROM (SELECT series_id, f, g, count(*) AS k FROM u GROUP BY ALL) GROUP BY series_id),
m AS (SELECT series_id, count(*) AS n_days, count(CASE WHEN cost > 0 THEN 1 END) AS n_trades, sum(net) AS total, avg(net) * 252 AS ann, stddev_samp(net) * sqrt(252::DOUBLE) AS vol, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252::DOUBLE) AS sharpe,
  avg(net) * 252 / nullif(stddev_samp(CASE WHEN net < 0 THEN net END) * sqrt(252::DOUBLE), 0) AS sortino, min(dd) AS max_dd, avg(net) * 252 / nullif(abs(min(dd)), 0) AS calmar, avg(CASE WHEN cost > 0 THEN (net > 0)::INT END) AS win_rate,
  avg(CASE WHEN cost > 0 AND net > 0 THEN net END) AS avg_win, avg(CASE WHEN cost > 0 AND net < 0 THEN net END) AS avg_loss, sum(CASE WHEN cost > 0 AND net > 0 THEN net END) / nullif(-sum(CASE WHEN cost > 0 AND net < 0 THEN net END), 0) AS profit_factor FROM e GROUP BY series_id)
SELECT * FROM m JOIN l USING (series_id)""", _METRICS, ())  # fmt: skip
def performance(spark, sf):
    """AG7: gains, risks, drawdowns and what the days on which contracts change bring."""
    s = strategy(spark, sf).withColumn("cum", F.sum("net").over(state.running()))
    s = state.run_length(s.withColumn("dd", state.drawdown(F.col("cum"))), F.col("dd") < 0)
    n, year, traded = F.col("net"), math.sqrt(252), F.col("cost") > 0
    when = lambda c: F.when(traded & c, n)
    return s.groupBy("series_id").agg(
        F.max("run").alias("longest_dd"), F.count(F.lit(1)).alias("n_days"), F.count(F.when(traded, 1)).alias("n_trades"),
        F.sum(n).alias("total"), (F.avg(n) * 252).alias("ann"), (F.stddev_samp(n) * year).alias("vol"), (F.avg(n) / F.nullif(F.stddev_samp(n), F.lit(0.0)) * year).alias("sharpe"),
        (F.avg(n) * 252 / F.nullif(F.stddev_samp(F.when(n < 0, n)) * year, F.lit(0.0))).alias("sortino"), F.min("dd").alias("max_dd"), (F.avg(n) * 252 / F.nullif(F.abs(F.min("dd")), F.lit(0.0))).alias("calmar"),
        F.avg(F.when(traded, (n > 0).cast("int"))).alias("win_rate"), F.avg(when(n > 0)).alias("avg_win"), F.avg(when(n < 0)).alias("avg_loss"), (F.sum(when(n > 0)) / F.nullif(-F.sum(when(n < 0)), F.lit(0.0))).alias("profit_factor"),
    )


@query("ag14_fiscal_yoy", "WITH y AS (SELECT o_orderpriority AS name, year(o_orderdate) AS y, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY ALL) SELECT a.name, a.y, a.v, (a.v / nullif(b.v, 0) - 1) * 100 AS yoy FROM y a LEFT JOIN y b ON b.name = a.name AND b.y = a.y - 1", ["v", "yoy"], ())
def fiscal(spark, sf):
    """AG14: a year's last value wins; growth on the year before."""
    o = views.table(spark, sf, "orders")
    y = o.groupBy(F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("y")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("v"))
    before = y.select("name", (F.col("y") + 1).alias("y"), F.col("v").alias("v0"))
    return y.join(before, ["name", "y"], "left").select("name", "y", "v", ((F.col("v") / F.nullif(F.col("v0"), F.lit(0.0)) - 1) * 100).alias("yoy"))


@query("ag18_robust_limits", f"{B} SELECT series_id, greatest(quantile_cont(abs(r), 0.85), 1e-6) AS lim, quantile_cont(iv, 0.1) AS p10, quantile_cont(iv, 0.9) AS p90 FROM b GROUP BY series_id", ["lim", "p10", "p90"], ())
def limits(spark, sf):
    """AG18: the limit of moves, and the tenths of implied volatility; no task holds the values of a series."""
    b = bars(spark, sf).select("series_id", "iv", F.abs("r").alias("move"))
    lim = hot.quantiles(b, "move", [0.85]).select("series_id", F.greatest("q0", F.lit(1e-6)).alias("lim"))
    return lim.join(hot.quantiles(b, "iv", [0.1, 0.9]).withColumnsRenamed({"q0": "p10", "q1": "p90"}), "series_id")


@query("bd12_ranking", f"{B}, l AS (SELECT * FROM b {LAST}) SELECT series_id, iv, rank() OVER (ORDER BY -iv DESC, series_id) AS strength_rank FROM l", ["iv"], ())
def ranking(spark, sf):
    """BD12, SL1, SL2: the latest row of each series, ranked (lower is stronger)."""
    return last(bars(spark, sf), ["iv"]).select("series_id", "iv", F.rank().over(W.orderBy(F.desc(-F.col("iv")), "series_id")).alias("strength_rank"))


# Weights of the reversion, momentum and news signals in each regime.
WEIGHTS = {"ranging": (0.70, 0.20, 0.10), "trending": (0.15, 0.75, 0.10), "crisis": (0.15, 0.10, 0.75)}
#: Regime probabilities from a move in its own deviations; the annualised volatility is in 100 rows.
PROBS = f"""v AS (SELECT series_id, dt, close, r, abs(r) AS a, {S.roll('r', 20, 'stddev_samp')} AS s FROM b), p AS (SELECT *, 1.0 / (1 + a / s) AS p0, a / s AS q FROM v WHERE s > 0),
n AS (SELECT series_id, dt, s * sqrt(252::DOUBLE) AS vol, p0 / (p0 + q + q * q) AS ranging, q / (p0 + q + q * q) AS trending, q * q / (p0 + q + q * q) AS crisis FROM p)"""
#: The same, with names that recursive walks leave free.
REGIMES = PROBS.replace(" p AS (", " pq AS (").replace("FROM p)", "FROM pq)")
#: A crisis by volatility: that of these tables' prices is about a hundred times that of rates, where it is 0.25.
CRISIS_VOL = 38.0
_DOMINANT = "CASE WHEN ranging >= trending AND ranging >= crisis THEN 'ranging' WHEN trending >= crisis THEN 'trending' ELSE 'crisis' END"
SOFT = {k: " + ".join(f"{WEIGHTS[g][i]!r} * {g}" for g in WEIGHTS) for i, k in enumerate(("mr", "mom", "news"))}
_HARD = {k: f"CASE {_DOMINANT} " + " ".join(f"WHEN '{g}' THEN {WEIGHTS[g][i]!r}" for g in WEIGHTS) + " END" for i, k in enumerate(("mr", "mom", "news"))}


def prob_columns(b):
    """Adds ranging, trending and crisis (summing to one) and vol; null where the deviation isn't known or is zero."""
    b = b.withColumn("__s", F.nullif(roll(F.col("r"), 20, F.stddev_samp), F.lit(0.0))).withColumn("__q", F.abs("r") / F.col("__s"))
    p0, q = 1.0 / (1 + F.col("__q")), F.col("__q")
    total = p0 + q + q * q
    return b.withColumns({"vol": F.col("__s") * math.sqrt(252), "ranging": p0 / total, "trending": q / total, "crisis": q * q / total}).drop("__s", "__q")


def regime_probs(b):
    """Rows whose probabilities are known, with them."""
    return prob_columns(b).filter("vol is not null")


def dominant():
    """The regime of the largest probability, the first of equal ones."""
    a, t, c = F.col("ranging"), F.col("trending"), F.col("crisis")
    return F.when((a >= t) & (a >= c), "ranging").when(t >= c, "trending").otherwise("crisis")


def signal_weights(soft: bool = True, news: bool = True):
    """Weights by signal: the expectation over regimes or the dominant one's; without news its weight goes to the others pro rata."""
    raw = {}
    for i, k in enumerate(("mr", "mom", "news")):
        if soft:
            raw[k] = sum((w[i] * F.col(g) for g, w in WEIGHTS.items()), F.lit(0.0))
        else:
            named = F.create_map(*(x for g, w in WEIGHTS.items() for x in (F.lit(g), F.lit(w[i]))))
            raw[k] = named[dominant()]
    if not news:
        tech = raw["mr"] + raw["mom"]
        raw = {"mr": raw["mr"] + raw["news"] * raw["mr"] / tech, "mom": raw["mom"] + raw["news"] * raw["mom"] / tech, "news": F.lit(0.0)}
    total = raw["mr"] + raw["mom"] + raw["news"]
    return {k: x / total for k, x in raw.items()}


def is_crisis(prob: float = 0.6, vol: float = 0.25):
    """A crisis by probability or by volatility; unknown is none."""
    return F.coalesce(F.col("crisis") > prob, F.lit(False)) | F.coalesce(F.col("vol") > vol, F.lit(False))


@query("st7_regime_weights", f"""{B}, {PROBS}, w AS (SELECT *, {', '.join(f'{x} AS s_{k}' for k, x in SOFT.items())}, {', '.join(f'{x} AS h_{k}' for k, x in _HARD.items())} FROM n)
SELECT series_id, dt, ranging, trending, crisis, {', '.join(f's_{k} / (s_mr + s_mom + s_news) AS w_{k}' for k in SOFT)}, {', '.join(f'h_{k} / (h_mr + h_mom + h_news) AS hard_{k}' for k in _HARD)}, s_mr / (s_mr + s_mom) AS tech_mr, s_mom / (s_mr + s_mom) AS tech_mom,
  {_DOMINANT} AS dominant, crisis > 0.6 OR vol > 0.25 AS is_crisis FROM w""", ["ranging", "trending", "crisis", *(f"w_{k}" for k in SOFT), *(f"hard_{k}" for k in _HARD), "tech_mr", "tech_mom"])  # fmt: skip
def weights(spark, sf):
    """ST7, ST9, ST10: weights of signals from regime probabilities, soft, of the dominant regime, and without news."""
    b = regime_probs(bars(spark, sf))
    tech = signal_weights(news=False)
    return b.select(
        "series_id", "dt", "ranging", "trending", "crisis", *(x.alias(f"w_{k}") for k, x in signal_weights().items()), *(x.alias(f"hard_{k}") for k, x in signal_weights(soft=False).items()),
        tech["mr"].alias("tech_mr"), tech["mom"].alias("tech_mom"), dominant().alias("dominant"), is_crisis().alias("is_crisis"),
    )
