"""The walk-forward backtest and the daily frame: fits, signals, blends and gains, by series and by fold."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import align, events, regimes, rolling, state, stats
from tidemark.operators.rolling import fill, roll
from tidemark.plans import sqltext as S
from tidemark.plans.boards import CRISIS_VOL, REGIMES, SOFT, is_crisis, prob_columns, signal_weights
from tidemark.plans.event_plans import CLASS_RATES, NEWS
from tidemark.plans.pair_plans import BOUNDS, FAIR, bounds, fair_value
from tidemark.plans.registry import query
from tidemark.plans.series_plans import B, bars
from tidemark.sources import views

TRAIN, TEST, STEP, LEAST = 104, 52, 26, 52
#: Entry and exit of the reversion, momentum and blended signals.
BANDS = {"mr": (1.5, 0.5, -1), "mom": (1.2, 0.4, 1), "blend": (1.3, 0.5, 1)}
COST, TARGET = 2.5, 0.1


#: What the fair value is taken from, and the unit in which it is a rate.
SOURCE, UNIT = "midpoint", 1e4
#: News of a month are spread over the years of the bars.
NEWS_FROM, NEWS_TIMES = "1995-01-02", 80


def fair_spread(spark, sf):
    """Bars with their rate, its fair value by PR17's choice, what it is off that, and the probabilities of regimes."""
    b = prob_columns(bars(spark, sf).select("series_id", "dt", "close", "r"))
    known = bounds(spark, sf, b.select("dt").distinct()).select("dt", (fair_value(SOURCE) / UNIT).alias("fair"))
    return b.join(known, "dt", "left").withColumn("spread", 100 - F.col("close") / 100 - F.col("fair"))


def news_z(spark, sf):
    """dt and z_news: the z-score of the decayed score of news, day by day, 0 where it isn't known."""
    n = views.news(spark, sf)
    first = n.agg(F.min("ts").alias("__first")).withColumn("one", F.lit(1))
    moved = F.timestamp_seconds(F.unix_seconds(F.lit(NEWS_FROM).cast("timestamp")) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("__first").cast("timestamp"))) * NEWS_TIMES / 1e6))
    n = n.withColumn("one", F.lit(1)).join(F.broadcast(first), "one").withColumn("ts", moved)
    days = n.agg(F.to_date(F.min("ts")).alias("a"), F.date_add(F.to_date(F.max("ts")), 10).alias("z")).select(F.explode(F.sequence("a", "z")).alias("dt"))
    scored = events.decayed_score(days, n).withColumn("series_id", F.lit("news"))
    return scored.select("dt", F.coalesce(rolling.zscore(F.col("score"), 63, 10), F.lit(0.0)).alias("z_news"))


def gains(df, by):
    """Adds held, contracts, net: the position of the row before, sized by volatility, less costs of changes; flat at first."""
    order = W.partitionBy(*by).orderBy("dt")
    before = lambda c: F.lag(c).over(order)
    df = df.withColumn("held", F.coalesce(before("position"), F.lit(0))).withColumn("__s", roll(F.col("r"), 20, F.stddev_samp, 5, order))
    df = df.withColumn("__s", F.coalesce(fill(F.col("__s"), w=order), fill(F.col("__s"), back=True, w=order)))
    size = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(TARGET / F.nullif(F.col("__s"), F.lit(0.0)) + 0.5)))
    df = df.withColumn("contracts", F.when((F.col("held") == 0) | F.col("__s").isNull(), 0).otherwise(F.col("held") * size).cast("double"))
    moved, change = F.col("close") - before("close"), F.abs(F.col("contracts") - F.coalesce(before("contracts"), F.lit(0.0)))
    return df.withColumn("net", F.coalesce(F.col("contracts") * moved, F.lit(0.0)) - COST * change).drop("__s")


def momentum_z(df, by):
    """Adds z_mom: the z-score in 26 rows of the momentum of falling rates at two horizons."""
    order = W.partitionBy(*by).orderBy("dt")
    df = df.withColumn("__c", -(F.col("close") - F.lag("close").over(order)))
    v = F.nullif(roll(F.col("__c"), 20, F.stddev_samp, w=order) * math.sqrt(252), F.lit(0.0))
    df = df.withColumn("__m", -(roll(F.col("__c"), 5, w=order) + roll(F.col("__c"), 21, w=order)) / 2 / v)
    m = F.col("__m")
    z = (m - roll(m, 26, F.avg, 13, order)) / F.nullif(roll(m, 26, F.stddev_samp, 13, order), F.lit(0.0))
    return df.withColumn("z_mom", z).drop("__c", "__m")


def blended(df, by, crisis, news=None):
    """Adds z, position and gains from z_mr, z_mom, the probabilities of regimes and news (a column, 0 where unknown), if there are any.

    In a crisis news alone count.  Where a signal has no z, neither has the blend: it holds no position, but keeps its state.
    """
    w = signal_weights(news=news is not None)
    tech = w["mr"] * F.col("z_mr") + w["mom"] * F.col("z_mom")
    df = df.withColumn("z", F.when(crisis, 0.0).otherwise(tech) + (w["news"] * news if news is not None else F.lit(0.0)))
    entry, leave, sign = BANDS["blend"]
    return gains(state.hysteresis(df, F.col("z"), entry, leave, sign=sign, by=by), by)


def folds(spark, sf, refit=False):
    """Test rows of all folds with the signals that each fold's training rows give them, and their gains.

    Probabilities of regimes are given ones, or with `refit` those of a switching model of each fold's training returns.

    A fold's regimes are those of its last training row, and its crises end with it; news go on.
    """
    by = ["series_id", "fold"]
    order = W.partitionBy(*by).orderBy("dt")
    rows = fair_spread(spark, sf).filter("spread is not null")
    many = align.folds(rows, TRAIN, TEST, STEP, LEAST)
    train = many.filter("part = 'train'").withColumn("p", F.when(F.col("crisis").isNotNull(), F.struct("ranging", "trending", "crisis")))
    train = train.withColumns({"x": F.lag("spread").over(order), "y": F.col("spread") - F.lag("spread").over(order)})
    slope = F.col("slope")
    fit = train.groupBy(*by).agg((F.covar_samp("y", "x") / F.var_samp("x")).alias("slope"), F.max_by("p", F.when(F.col("p").isNotNull(), F.col("dt"))).alias("p"))
    fit = fit.withColumn("half_life", F.when(slope < 0, math.log(2) / -slope)).withColumn("w", F.greatest(F.lit(20), F.floor(2 * F.col("half_life"))).cast("int"))
    fit = fit.withColumn("w", F.when(F.col("half_life").isNotNull(), F.least("w", F.lit(TEST))))
    fit = fit.select(*by, "half_life", "w", "p.*")
    if refit:
        names = ["ranging", "trending", "crisis"]
        fit = fit.drop(*names).join(regimes.fold_regimes(train.select(*by, "dt", "r"), "r", by).select(*by, *names), by, "left")
    test = many.filter("part = 'test'").drop("ranging", "trending", "crisis", "vol").join(fit, by)
    # A fold has TEST rows at most, so a row's window, which is its fold's own, is the end of a short list.
    seen = F.collect_list("spread").over(order.rowsBetween(W.unboundedPreceding, 0))
    test = test.withColumn("__a", F.slice(seen, F.greatest(F.lit(1), F.size(seen) - F.col("w") + 1), F.col("w")))
    n, total = F.size("__a"), lambda f: F.aggregate("__a", F.lit(0.0), f)
    mean = total(lambda s, x: s + x) / n
    test = test.withColumn("__mean", mean)
    dev = F.sqrt(total(lambda s, x: s + (x - F.col("__mean")) * (x - F.col("__mean"))) / F.nullif(n - 1, F.lit(0)))
    test = test.withColumn("z_mr", F.when(n >= F.floor(F.col("w") / 2), (F.col("spread") - F.col("__mean")) / F.nullif(dev, F.lit(0.0)))).drop("__a", "__mean")
    told = momentum_z(test, by).join(news_z(spark, sf), "dt", "left")
    return blended(told, by, F.lit(False), F.coalesce("z_news", F.lit(0.0)))


_WF = "PARTITION BY series_id, fold ORDER BY dt"
_FAIR = f"""{BOUNDS}, sp AS (SELECT b.series_id, b.dt, b.close, b.r, ({FAIR[SOURCE]}) / {UNIT} AS fair, 100 - b.close / 100 - ({FAIR[SOURCE]}) / {UNIT} AS spread FROM b LEFT JOIN fair USING (dt))"""
_NEWS = f"""{NEWS.removeprefix('WITH ').replace('WITH n AS', 'n AS').replace('n AS (SELECT event_id, ts,', "nw AS (SELECT event_id, TIMESTAMP '" + NEWS_FROM + "' + to_seconds(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * " + str(NEWS_TIMES) + " / 1e6)::BIGINT) AS ts,").replace('FROM n)', 'FROM nw)').replace('i AS (', 'ni AS (').replace('m AS (SELECT *, floor', 'nm AS (SELECT *, floor').replace('FROM i)', 'FROM ni)')},
nc(class, lf, ls, wf) AS (VALUES {CLASS_RATES}), ne AS (SELECT ts, impulse, lf, ls, wf FROM nm JOIN nc ON class = CASE WHEN event_class IN ({', '.join(repr(k) for k in events.CLASSES)}) THEN event_class ELSE 'noise' END WHERE impulse <> 0),
nd AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE + 10, INTERVAL 1 DAY))::DATE AS dt FROM nw),
ns AS (SELECT dt, coalesce(sum(impulse * (wf * exp(-lf * x) + (1 - wf) * exp(-ls * x))), 0) AS score FROM (SELECT dt, ne.*, epoch_us(dt::TIMESTAMP) / 86400e6 - epoch_us(ts) / 86400e6 AS x FROM nd LEFT JOIN ne ON ts < dt) GROUP BY dt),
nz AS (SELECT dt, coalesce((score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0), 0) * (count(score) OVER w >= 10)::INT AS z_news FROM ns WINDOW w AS (ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))"""


def _roll(x: str, n: int, agg: str = "avg", least: int | None = None, part: str = _WF) -> str:
    over = f"OVER ({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {n if least is None else least} THEN {agg}({x}) {over} END"


def _mom(src: str, part: str) -> str:
    return f"""mc AS (SELECT *, -(close - lag(close) OVER ({part})) AS c FROM {src}),
mm AS (SELECT *, -(({_roll('c', 5, part=part)}) + ({_roll('c', 21, part=part)})) / 2 / nullif(({_roll('c', 20, 'stddev_samp', part=part)}) * sqrt(252::DOUBLE), 0) AS m FROM mc),
mz AS (SELECT *, (m - ({_roll('m', 26, 'avg', 13, part)})) / nullif({_roll('m', 26, 'stddev_samp', 13, part)}, 0) AS z_mom FROM mm)"""


_ALL3 = f"(({SOFT['mr']}) + ({SOFT['mom']}) + ({SOFT['news']}))"
_TWO = f"(({SOFT['mr']}) * z_mr + ({SOFT['mom']}) * z_mom) / (({SOFT['mr']}) + ({SOFT['mom']}))"
_THREE = f"(({SOFT['mr']}) * z_mr + ({SOFT['mom']}) * z_mom) / {_ALL3} + ({SOFT['news']}) / {_ALL3} * coalesce(z_news, 0)"
_CRISIS = f"(coalesce(crisis > 0.6, false) OR coalesce(vol > {CRISIS_VOL}, false))"


def _state(z: str, name: str) -> tuple[str, str]:
    entry, leave, sign = BANDS[name]
    begin = f"CASE WHEN {z} > {entry} THEN {sign} WHEN {z} < -{entry} THEN -({sign}) ELSE 0 END"
    p, s = f"p.s_{name}", f"s.{z}"
    on = f"CASE WHEN {s} IS NULL THEN {p} WHEN {p} = 0 AND {s} > {entry} THEN {sign} WHEN {p} = 0 AND {s} < -{entry} THEN -({sign}) WHEN {p} <> 0 AND abs({s}) < {leave} THEN 0 ELSE {p} END"
    return begin, on


def _gains(src: str, part: str) -> str:
    return f"""h AS (SELECT *, coalesce(lag(position) OVER ({part}), 0) AS held, {_roll('r', 20, 'stddev_samp', 5, part)} AS s0 FROM {src}),
hs AS (SELECT *, coalesce(last_value(s0 IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(s0 IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sg FROM h),
ct AS (SELECT *, (CASE WHEN held = 0 OR sg IS NULL THEN 0 ELSE held * greatest(1, least(10, floor({TARGET} / nullif(sg, 0) + 0.5))) END)::DOUBLE AS contracts FROM hs),
g AS (SELECT *, coalesce(contracts * (close - lag(close) OVER ({part})), 0) - {COST} * abs(contracts - coalesce(lag(contracts) OVER ({part}), 0)) AS net FROM ct)"""


_ENTER, _ON = _state("z", "blend")
_FOLDS = f"""{B.replace('WITH', 'WITH RECURSIVE', 1)}, {_FAIR}, {_NEWS}, {REGIMES},
y AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dt) - 1 AS i FROM sp WHERE spread IS NOT NULL),
f AS (SELECT series_id, fold, {LEAST} + fold * {STEP} AS pos FROM (SELECT series_id, max(i) + 1 AS rows FROM y GROUP BY 1), LATERAL (SELECT unnest(range(0, greatest(0, (rows - {TEST} - {LEAST}) // {STEP} + 1))) AS fold)),
tr AS (SELECT f.series_id, fold, y.dt, spread - lag(spread) OVER w AS dy, lag(spread) OVER w AS lx FROM f JOIN y ON y.series_id = f.series_id AND i < pos AND i >= pos - {TRAIN} WINDOW w AS (PARTITION BY f.series_id, fold ORDER BY y.dt)),
pr AS (SELECT series_id, fold, arg_max(ranging, dt) AS ranging, arg_max(trending, dt) AS trending, arg_max(crisis, dt) AS crisis FROM tr JOIN n USING (series_id, dt) GROUP BY ALL),
ft AS (SELECT series_id, fold, covar_samp(dy, lx) / var_samp(lx) AS slope FROM tr GROUP BY ALL),
fh AS (SELECT series_id, fold, ranging, trending, crisis, CASE WHEN slope < 0 THEN ln(2) / -slope END AS half_life FROM ft LEFT JOIN pr USING (series_id, fold)),
oos AS (SELECT f.series_id, f.fold, y.dt, close, r, spread, ranging, trending, crisis, half_life, CASE WHEN half_life IS NOT NULL THEN least({TEST}, greatest(20, floor(2 * half_life))) END::INT AS w, row_number() OVER (PARTITION BY f.series_id, f.fold ORDER BY y.dt) AS k
  FROM f JOIN y ON y.series_id = f.series_id AND i >= pos AND i < pos + {TEST} JOIN fh ON fh.series_id = f.series_id AND fh.fold = f.fold),
zs AS (SELECT a.series_id, a.fold, a.k, CASE WHEN count(*) >= any_value(a.w) // 2 THEN (any_value(a.spread) - avg(c.spread)) / nullif(stddev_samp(c.spread), 0) END AS z_mr FROM oos a JOIN oos c ON c.series_id = a.series_id AND c.fold = a.fold AND c.k > a.k - a.w AND c.k <= a.k GROUP BY ALL),
oz AS (SELECT * FROM oos LEFT JOIN zs USING (series_id, fold, k)), {_mom('oz', _WF)}, bl AS (SELECT mz.*, {_THREE} AS z FROM mz LEFT JOIN nz USING (dt)),
wk AS (SELECT series_id, fold, k, {_ENTER} AS s_blend FROM bl WHERE k = 1 UNION ALL SELECT s.series_id, s.fold, s.k, {_ON} FROM wk p JOIN bl s ON s.series_id = p.series_id AND s.fold = p.fold AND s.k = p.k + 1),
ps AS (SELECT bl.*, CASE WHEN z IS NULL THEN 0 ELSE s_blend END AS position FROM bl JOIN wk USING (series_id, fold, k)), {_gains('ps', _WF)}"""


@query("st15_walk_forward", f"""{_FOLDS}, l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY series_id, dt ORDER BY fold DESC) = 1)
SELECT series_id, dt, fold::INT AS fold, half_life, z_mr, z_mom, z, position, contracts, net, sum(net) {S.ALL} AS cum FROM l""", ["half_life", "z_mr", "z_mom", "z", "contracts", "net", "cum"])  # fmt: skip
def walk_forward(spark, sf):
    """ST15, DD2: fits on training rows, signals and gains on test rows, of overlapping folds the last one; gains added up anew."""
    stitched = align.latest_fold(folds(spark, sf), ["series_id", "dt"])
    return stitched.select("series_id", "dt", "fold", "half_life", "z_mr", "z_mom", "z", "position", "contracts", "net", F.sum("net").over(state.running()).alias("cum"))


@query("st15_walk_forward_refitted")
def walk_forward_refitted(spark, sf):
    """ST15, ST14: the same with regimes refitted on each fold's training rows; no SQL can express the fit."""
    stitched = align.latest_fold(folds(spark, sf, refit=True), ["series_id", "dt"])
    return stitched.select("series_id", "dt", "fold", "half_life", "ranging", "trending", "crisis", "z_mr", "z_mom", "z", "position", "contracts", "net", F.sum("net").over(state.running()).alias("cum"))


_SHARPE = "avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)"


@query("ag12_fold_rollup", f"{_FOLDS}, fm AS (SELECT series_id, fold, sum(net) AS total, {_SHARPE.replace('252', '252::DOUBLE')} AS sharpe FROM g GROUP BY ALL) SELECT series_id, count(*) AS folds, avg((total > 0)::INT) AS positive, median(sharpe) AS median_sharpe, avg(sharpe) AS mean_sharpe, stddev_samp(sharpe) AS std_sharpe, sum(total) AS total FROM fm GROUP BY series_id", ["positive", "median_sharpe", "mean_sharpe", "std_sharpe", "total"], ())
def rollup(spark, sf):
    """AG12: how many folds gain, and the middle, mean and spread of their Sharpe ratios."""
    m = folds(spark, sf).groupBy("series_id", "fold").agg(F.sum("net").alias("total"), F.expr(_SHARPE).alias("sharpe"))
    return m.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("folds"), F.avg((F.col("total") > 0).cast("int")).alias("positive"), F.percentile("sharpe", 0.5).alias("median_sharpe"), F.avg("sharpe").alias("mean_sharpe"),
        F.stddev_samp("sharpe").alias("std_sharpe"), F.sum("total").alias("total"),
    )


_S1 = "PARTITION BY series_id ORDER BY dt"
_STATES = {k: _state({"mr": "z_mr", "mom": "z_mom", "blend": "z"}[k], k) for k in BANDS}
_FRAME = ["close", "fair", "spread", "z_mr", "z_mom", "z", "contracts", "net", "cum"]


_T = "slope / sqrt((vy - slope * slope * vx) / (m - 2) / vx)"
_DAILY = f"""{B.replace('WITH', 'WITH RECURSIVE', 1)}, {_FAIR}, {REGIMES},
ou AS (SELECT series_id, spread - lag(spread) {S.W} AS dy, lag(spread) {S.W} AS lx FROM sp), fs AS (SELECT series_id, covar_samp(dy, lx) / var_samp(CASE WHEN dy IS NOT NULL THEN lx END) AS slope, count(dy) AS m, var_samp(CASE WHEN lx IS NOT NULL THEN dy END) AS vy, var_samp(CASE WHEN dy IS NOT NULL THEN lx END) AS vx FROM ou GROUP BY series_id),
ff AS (SELECT *, CASE WHEN slope < 0 THEN ln(2) / -slope END AS half_life, coalesce(slope < 0 AND {S.t_p_value(_T, 'm - 2')} < 0.10, false) AS reverts FROM fs),
idle AS (SELECT series_id, half_life, CASE WHEN half_life IS NOT NULL THEN greatest(20, floor(2 * half_life)) END::INT AS w, NOT reverts AND (coalesce(half_life, 1e9) < 3 OR coalesce(half_life, 1e9) > 120) AS idle FROM ff),
sk AS (SELECT sp.*, half_life, w, idle, row_number() {S.W} AS k FROM sp JOIN idle USING (series_id)),
zz AS (SELECT a.series_id, a.dt, any_value(a.close) AS close, any_value(a.r) AS r, any_value(a.fair) AS fair, any_value(a.spread) AS spread, any_value(a.half_life) AS half_life, any_value(a.idle) AS idle,
  CASE WHEN NOT any_value(a.idle) AND count(c.spread) >= any_value(a.w) // 2 THEN (any_value(a.spread) - avg(c.spread)) / nullif(stddev_samp(c.spread), 0) END AS z_mr FROM sk a JOIN sk c ON c.series_id = a.series_id AND c.k > a.k - coalesce(a.w, 1) AND c.k <= a.k GROUP BY a.series_id, a.dt),
{_mom('zz', _S1)}, bl AS (SELECT mz.*, ranging, trending, crisis, {_CRISIS} AS is_crisis, row_number() OVER (PARTITION BY mz.series_id ORDER BY mz.dt) AS k FROM mz LEFT JOIN n USING (series_id, dt)),
bz AS (SELECT *, CASE WHEN is_crisis THEN 0 ELSE {_TWO} END AS z FROM bl),
wk AS (SELECT series_id, k, {', '.join(f'{v[0]} AS s_{n}' for n, v in _STATES.items())} FROM bz WHERE k = 1 UNION ALL SELECT s.series_id, s.k, {', '.join(v[1] for v in _STATES.values())} FROM wk p JOIN bz s ON s.series_id = p.series_id AND s.k = p.k + 1),
ps AS (SELECT bz.*, CASE WHEN z_mr IS NULL THEN 0 ELSE s_mr END AS signal_mr, CASE WHEN z_mom IS NULL THEN 0 ELSE s_mom END AS signal_mom, CASE WHEN z IS NULL THEN 0 ELSE s_blend END AS position FROM bz JOIN wk USING (series_id, k)), {_gains('ps', _S1)}
"""


@query("bd13_daily_frame", f"""{_DAILY} SELECT series_id, dt, close, fair, spread, z_mr, signal_mr, z_mom, signal_mom, z, position, is_crisis, contracts, net, sum(net) {S.ALL} AS cum FROM g""", _FRAME)
def daily_frame(spark, sf):
    """BD13: reversion and momentum signals, their blend by regime, and gains, one row for each bar."""
    by = ["series_id"]
    s = momentum_z(reversion(spark, sf), by)
    entry, leave, sign = BANDS["mom"]
    s = state.hysteresis(s, F.col("z_mom"), entry, leave, "signal_mom", sign).withColumn("is_crisis", is_crisis(vol=CRISIS_VOL))
    s = blended(s, by, F.col("is_crisis"))
    return s.select(
        "series_id", "dt", "close", "fair", "spread", "z_mr", "signal_mr", "z_mom", "signal_mom", "z", "position", "is_crisis", "contracts", "net",
        F.sum("net").over(state.running()).alias("cum"),
    )


def reversion(spark, sf):
    """Adds z_mr, half_life and signal_mr to the spreads.

    A fit reverts if its slope is negative with a p-value under 0.10.  A series whose fit doesn't, and whose half-life is
    under 3 or over 120 rows, has no z and no position; else z is over two half-lives, 20 rows at least.
    """
    order = W.partitionBy("series_id").orderBy("dt")
    s = fair_spread(spark, sf)
    x, slope = F.col("spread"), F.col("slope")
    lagged = s.select("series_id", F.lag(x).over(order).alias("lx"), (x - F.lag(x).over(order)).alias("dy")).filter("lx is not null and dy is not null")
    fit = lagged.groupBy("series_id").agg((F.covar_samp("dy", "lx") / F.var_samp("lx")).alias("slope"), F.count(F.lit(1)).alias("m"), F.var_samp("dy").alias("vy"), F.var_samp("lx").alias("vx"))
    t = slope / F.sqrt((F.col("vy") - slope * slope * F.col("vx")) / (F.col("m") - 2) / F.col("vx"))
    fit = fit.withColumn("half_life", F.when(slope < 0, math.log(2) / -slope)).withColumn("reverts", F.coalesce((slope < 0) & (stats.t_p_value(t, F.col("m") - 2) < 0.10), F.lit(False)))
    life = F.coalesce("half_life", F.lit(1e9))
    fit = fit.select("series_id", "half_life", F.greatest(F.lit(20), F.floor(2 * F.col("half_life"))).cast("int").alias("w"), (~F.col("reverts") & ((life < 3) | (life > 120))).alias("idle"))
    s = rolling.zscore_by_length(s.join(fit, "series_id"), "spread", "w", "z_mr").withColumn("z_mr", F.when(~F.col("idle"), F.col("z_mr")))
    entry, leave, sign = BANDS["mr"]
    return state.hysteresis(s, F.col("z_mr"), entry, leave, "signal_mr", sign)


@query("st16_reversion_assembly", f"""{_DAILY} SELECT series_id, dt, fair, spread, z_mr AS z, half_life, signal_mr AS position FROM ps""", ["fair", "spread", "z", "half_life"])
def reversion_assembly(spark, sf):
    """ST16: spreads off a fair value, their fit, z-scores and positions."""
    return reversion(spark, sf).select("series_id", "dt", "fair", "spread", F.col("z_mr").alias("z"), "half_life", F.col("signal_mr").alias("position"))
