"""Queries over implied and realised volatility by tenor, and over the calibration of estimators."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import rolling
from tidemark.operators.ewm import ewm
from tidemark.operators.rolling import lag, roll
from tidemark.plans import sqltext as S
from tidemark.plans.registry import query
from tidemark.plans.series_plans import B, EST, bars

#: Rows of a tenor.
TENORS = {"1W": 5, "2W": 10, "1M": 21, "3M": 63, "6M": 126, "1Y": 252}
LOOKBACK = 52
_K = lambda n: 0.34 / (1.34 + (n + 1) / (n - 1))
_E = f"e AS (SELECT *, {EST[0]} AS hl, {EST[1]} AS co, {EST[2]} AS rs, ln(open / lag(close) {S.W}) AS gap FROM b)"


def _yz(n: int, clip: bool = True) -> str:
    v = f"(({S.roll('gap', n, 'var_samp')}) + {_K(n)!r} * ({S.roll('co', n, 'var_samp')}) + {1 - _K(n)!r} * ({S.roll('rs', n)}))"
    return f"CASE WHEN {v} IS NOT NULL THEN sqrt(greatest({v}, 0) * 252) * 100 END" if clip else f"sqrt(CASE WHEN {v} >= 0 THEN {v} END * 252) * 100"


# An implied volatility for each tenor, missing in one week of eleven.
_PANEL = f"""{_E}, y AS (SELECT series_id, dt, rn, iv, {', '.join(f"{_yz(n)} AS rv_{k}" for k, n in TENORS.items())} FROM e),
l AS ({' UNION ALL '.join(f"SELECT series_id, dt, '{k}' AS tenor, CASE WHEN rn % 11 > 0 THEN iv + ln({n}::DOUBLE) END AS raw, rv_{k} AS rv FROM y" for k, n in TENORS.items())}),
p AS (SELECT series_id, tenor, dt, last_value(raw IGNORE NULLS) OVER (PARTITION BY series_id, tenor ORDER BY dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS iv, rv FROM l),
q AS (SELECT *, CASE WHEN rv > 0 THEN ln(iv / rv) END AS ratio FROM p)"""


def yang_zhang(n: int):
    """The estimator over n rows; its rows need `gap`, the log of an open over the close before."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rs = F.log(h / c) * F.log(h / o) + F.log(low / c) * F.log(low / o)
    v = roll(F.col("gap"), n, F.var_samp) + _K(n) * roll(F.log(c / o), n, F.var_samp) + (1 - _K(n)) * roll(rs, n)
    return F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0)) * 252) * 100)


def panel(spark, sf):
    """series_id, tenor, dt, iv (carried over three rows at most), rv and ratio: all tenors from one pass over the bars."""
    b = bars(spark, sf).withColumn("gap", F.log(F.col("open") / lag(F.col("close"))))
    wide = b.select("series_id", "dt", "rn", "iv", *(yang_zhang(n).alias(k) for k, n in TENORS.items()))
    steps = F.create_map(*(F.lit(x) for k, n in TENORS.items() for x in (k, float(n))))
    long = wide.unpivot(["series_id", "dt", "rn", "iv"], list(TENORS), "tenor", "rv").withColumn("iv", F.when(F.col("rn") % 11 > 0, F.col("iv") + F.log(steps[F.col("tenor")])))
    long = long.withColumn("iv", rolling.fill(F.col("iv"), 3, w=W.partitionBy("series_id", "tenor").orderBy("dt")))
    return long.withColumn("ratio", F.when(F.col("rv") > 0, F.log(F.col("iv") / F.col("rv")))).drop("rn")


_T = "PARTITION BY series_id, tenor ORDER BY dt"


@query("wn6_ratio_zscores", f"{B}, {_PANEL} SELECT series_id, tenor, dt, ratio, CASE WHEN count(ratio) OVER w = {LOOKBACK} THEN (ratio - avg(ratio) OVER w) / nullif(stddev_samp(ratio) OVER w, 0) END AS z FROM q WINDOW w AS ({_T} ROWS BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW)", ["ratio", "z"])
def ratio_zscores(spark, sf):
    """WN6: the rolling z-score of log implied over realised volatility, by tenor."""
    w = W.partitionBy("series_id", "tenor").orderBy("dt")
    x = F.col("ratio")
    z = (x - roll(x, LOOKBACK, w=w)) / F.nullif(roll(x, LOOKBACK, F.stddev_samp, w=w), F.lit(0.0))
    return panel(spark, sf).select("series_id", "tenor", "dt", "ratio", z.alias("z"))


@query("wn35_jn13_vol_snapshot", f"""{B}, {_PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id, tenor ORDER BY dt DESC) AS back FROM q), t AS (SELECT *, max(CASE WHEN back = 1 THEN ratio END) OVER (PARTITION BY series_id, tenor) AS now FROM k WHERE back <= {LOOKBACK})
SELECT series_id, tenor, max(dt) AS dt, arg_max(iv, dt) FILTER (back = 1) AS iv, arg_max(rv, dt) FILTER (back = 1) AS rv, (max(now) - avg(ratio)) / nullif(stddev_samp(ratio), 0) AS z,
  CASE WHEN max(now) IS NOT NULL THEN 100.0 * (count(CASE WHEN ratio < now THEN 1 END) + (count(CASE WHEN ratio = now THEN 1 END) + 1) / 2.0) / count(ratio) END AS pct FROM t GROUP BY series_id, tenor""", ["iv", "rv", "z", "pct"])  # fmt: skip
def snapshot(spark, sf):
    """WN35, JN13, WN20c: the latest volatilities of each series and tenor, with z and percentile in the last rows there are."""
    back = W.partitionBy("series_id", "tenor").orderBy(F.desc("dt"))
    t = panel(spark, sf).withColumn("back", F.row_number().over(back)).filter(F.col("back") <= LOOKBACK)
    t = t.withColumn("now", F.first("ratio").over(back))
    x, now = F.col("ratio"), F.max("now")
    below = F.count(F.when(x < F.col("now"), 1)) + (F.count(F.when(x == F.col("now"), 1)) + 1) / 2
    return t.groupBy("series_id", "tenor").agg(
        F.max("dt").alias("dt"), F.max_by("iv", "dt").alias("iv"), F.max_by("rv", "dt").alias("rv"), ((now - F.avg(x)) / F.nullif(F.stddev_samp(x), F.lit(0.0))).alias("z"),
        F.when(now.isNotNull(), 100.0 * below / F.count(x)).alias("pct"),
    )


_BOARD = {"1W": 5, "1M": 21, "3M": 63, "6M": 126, "1Y": 252}
_EWMA = f"xs AS (SELECT series_id, dt, r * r AS x, row_number() {S.W} AS rn FROM b WHERE r IS NOT NULL), ew AS {S.ewm('xs', 'x', 'v', 1 - 0.94, False)}"
_RANK = lambda n: f"CASE WHEN count(p.spread) = {n} THEN 100.0 * sum((p.spread < c.spread)::INT) / {n - 1} END"


@query("bd7_iv_rv_board", f"""{B}, {_E}, {_EWMA}, y AS (SELECT e.series_id, e.dt, e.iv, sqrt(v * 252) * 100 AS ewma, {', '.join(f"{_yz(n)} AS rv_{k}" for k, n in _BOARD.items()).replace('PARTITION BY series_id ORDER BY dt', 'PARTITION BY e.series_id ORDER BY e.dt')} FROM e LEFT JOIN ew USING (series_id, dt)),
l AS ({' UNION ALL '.join(f"SELECT series_id, dt, '{k}' AS tenor, iv, ewma, rv_{k} AS rv, iv - rv_{k} AS spread, iv - ewma AS ewma_spread FROM y" for k in _BOARD)}),
f AS (SELECT *, row_number() OVER (PARTITION BY series_id, tenor ORDER BY dt DESC) AS back FROM l WHERE spread IS NOT NULL),
c AS (SELECT * FROM f WHERE back = 1),
r1 AS (SELECT c.series_id, c.tenor, {_RANK(52)} AS rank_1y FROM c JOIN f p ON p.series_id = c.series_id AND p.tenor = c.tenor AND p.back <= 52 GROUP BY ALL),
r2 AS (SELECT c.series_id, c.tenor, {_RANK(104)} AS rank_2y FROM c JOIN f p ON p.series_id = c.series_id AND p.tenor = c.tenor AND p.back <= 104 GROUP BY ALL)
SELECT series_id, tenor, dt, iv, rv, ewma, spread, ewma_spread, rank_1y, rank_2y, CASE WHEN rank_1y >= 75 THEN 'RICH' WHEN rank_1y <= 25 THEN 'CHEAP' ELSE 'NEUTRAL' END AS signal FROM c JOIN r1 USING (series_id, tenor) JOIN r2 USING (series_id, tenor)""",
    ["iv", "rv", "ewma", "spread", "ewma_spread", "rank_1y", "rank_2y"])
def iv_rv(spark, sf):
    """BD7: implied less realised volatility of two estimators in five tenors, its ranks in one and two years, rich or cheap."""
    b = ewm(bars(spark, sf).withColumn("gap", F.log(F.col("open") / lag(F.col("close")))).withColumn("x", F.col("r") * F.col("r")), F.col("x"), "v", 1 - 0.94, adjust=False)
    wide = b.select("series_id", "dt", "iv", F.when(F.col("r").isNotNull(), F.sqrt(F.col("v") * 252) * 100).alias("ewma"), *(yang_zhang(n).alias(k) for k, n in _BOARD.items()))
    long = wide.unpivot(["series_id", "dt", "iv", "ewma"], list(_BOARD), "tenor", "rv").withColumns({"spread": F.col("iv") - F.col("rv"), "ewma_spread": F.col("iv") - F.col("ewma")})
    back = W.partitionBy("series_id", "tenor").orderBy(F.desc("dt"))
    # Only the last rows are ranked, so they are cut first.
    t = long.filter("spread is not null").withColumn("back", F.row_number().over(back)).filter("back <= 104").withColumn("now", F.first("spread").over(back))
    rank = lambda n: F.when(F.count(F.when(F.col("back") <= n, 1)) == n, 100.0 * F.count(F.when((F.col("back") <= n) & (F.col("spread") < F.col("now")), 1)) / (n - 1))
    g = t.groupBy("series_id", "tenor").agg(*(F.max_by(c, "dt").alias(c) for c in ("iv", "rv", "ewma", "spread", "ewma_spread")), F.max("dt").alias("dt"), rank(52).alias("rank_1y"), rank(104).alias("rank_2y"))
    one = F.col("rank_1y")
    return g.select("series_id", "tenor", "dt", "iv", "rv", "ewma", "spread", "ewma_spread", "rank_1y", "rank_2y", F.when(one >= 75, "RICH").when(one <= 25, "CHEAP").otherwise("NEUTRAL").alias("signal"))


# The realised volatility of a week's days stands for the high-frequency one.
_CAL = f"""{S.bars('day')}, days AS (SELECT series_id, date_trunc('week', dt)::DATE AS dt, sqrt(sum(r * r) * 252 / 5) * 100 AS hf FROM b WHERE r IS NOT NULL GROUP BY ALL), """


def _cal() -> str:
    daily = _CAL.replace("bars AS (", "dbars AS (").replace("FROM bars WINDOW", "FROM dbars WINDOW").replace("b AS (SELECT *, row_number()", "db AS (SELECT *, row_number()").replace("FROM b WHERE", "FROM db WHERE")
    weekly = B[B.index("bars AS ("):]
    return f"""{daily}{weekly}, {_E}, {_EWMA}, est AS (SELECT e.series_id, e.dt, {_yz(21).replace('PARTITION BY series_id ORDER BY dt', 'PARTITION BY e.series_id ORDER BY e.dt')} AS yz, sqrt(v * 252) * 100 AS ewma FROM e LEFT JOIN ew USING (series_id, dt)),
c AS (SELECT est.series_id, est.dt, yz, ewma, hf FROM est JOIN days USING (series_id, dt) WHERE yz IS NOT NULL AND ewma IS NOT NULL AND hf IS NOT NULL)"""


def calibrated(spark, sf):
    """JN1: both estimators and the volatility from daily bars, on the weeks that have all three."""
    d = bars(spark, sf, "day").filter("r is not null").groupBy("series_id", F.to_date(F.date_trunc("week", "dt")).alias("dt")).agg((F.sqrt(F.sum(F.col("r") * F.col("r")) * 252 / 5) * 100).alias("hf"))
    b = ewm(bars(spark, sf).withColumn("gap", F.log(F.col("open") / lag(F.col("close")))).withColumn("x", F.col("r") * F.col("r")), F.col("x"), "v", 1 - 0.94, adjust=False)
    e = b.select("series_id", "dt", yang_zhang(21).alias("yz"), F.when(F.col("r").isNotNull(), F.sqrt(F.col("v") * 252) * 100).alias("ewma"))
    return e.join(d, ["series_id", "dt"]).na.drop(subset=["yz", "ewma", "hf"])


@query("jn1_joined_estimators", f"{_cal()} SELECT series_id, dt, yz, ewma, hf, yz - hf AS yz_spread, ewma - hf AS ewma_spread FROM c", ["yz", "ewma", "hf", "yz_spread", "ewma_spread"])
def joined(spark, sf):
    """JN1: series joined on their common dates, rows with a missing value dropped, and their spreads."""
    return calibrated(spark, sf).select("series_id", "dt", "yz", "ewma", "hf", (F.col("yz") - F.col("hf")).alias("yz_spread"), (F.col("ewma") - F.col("hf")).alias("ewma_spread"))


@query("wn26_rolling_errors", f"{_cal()} SELECT series_id, dt, sqrt({S.roll('(yz - hf) * (yz - hf)', 10)}) AS rmse, {S.roll('abs(yz - hf)', 10)} AS mae, CASE WHEN count(yz) {S.frame(10)} = 10 THEN corr(yz, hf) {S.frame(10)} END AS corr FROM c", ["rmse", "mae", "corr"])
def errors(spark, sf):
    """WN26: error, absolute error and correlation in ten rows."""
    x, y = F.col("yz"), F.col("hf")
    over = rolling.series().rowsBetween(-9, 0)
    return calibrated(spark, sf).select("series_id", "dt", F.sqrt(roll((x - y) * (x - y), 10)).alias("rmse"), roll(F.abs(x - y), 10).alias("mae"), F.when(F.count(x).over(over) == 10, F.corr(x, y).over(over)).alias("corr"))


_SUM = {f"{k}_{m}": q for k in ("yz", "ewma") for m, q in (("rmse", f"sqrt(avg(({k} - hf) * ({k} - hf)))"), ("mae", f"avg(abs({k} - hf))"), ("bias", f"avg({k} - hf)"), ("corr", f"corr({k}, hf)"))}


@query("ag11_calibration", f"{_cal()}, s AS (SELECT series_id, count(*) AS n, {', '.join(f'{q} AS {c}' for c, q in _SUM.items())} FROM c GROUP BY series_id) SELECT *, CASE WHEN yz_rmse < ewma_rmse THEN 'Yang-Zhang' ELSE 'EWMA' END AS winner FROM s", list(_SUM), ())
def calibration(spark, sf):
    """AG11: how far each estimator is off the daily one, and which is nearer."""
    s = calibrated(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), *(F.expr(q).alias(c) for c, q in _SUM.items()))
    return s.withColumn("winner", F.when(F.col("yz_rmse") < F.col("ewma_rmse"), "Yang-Zhang").otherwise("EWMA"))


MOMENTUM = f"""rt AS (SELECT series_id, dt, (100 - close / 100 - lag(100 - close / 100) {S.W}) * 100 AS c FROM b), mv AS (SELECT *, nullif(({S.roll('c', 20, 'stddev_samp')}) * sqrt(252::DOUBLE), 0) AS v FROM rt),
mo AS (SELECT series_id, dt, -({S.roll('c', 5)}) / v AS fast_mom, -({S.roll('c', 21)}) / v AS slow_mom FROM mv)"""


def dispersion_momentum(b, fast: int = 5, slow: int = 21, window: int = 20):
    """Adds fast_mom, slow_mom and blended_mom: mean changes of the rate over their annualised deviation, falling rates up."""
    b = b.withColumn("__rate", 100 - F.col("close") / 100).withColumn("__c", (F.col("__rate") - lag(F.col("__rate"))) * 100)
    v = F.nullif(roll(F.col("__c"), window, F.stddev_samp) * math.sqrt(252), F.lit(0.0))
    b = b.withColumns({"fast_mom": -roll(F.col("__c"), fast) / v, "slow_mom": -roll(F.col("__c"), slow) / v})
    return b.withColumn("blended_mom", (F.col("fast_mom") + F.col("slow_mom")) / 2).drop("__rate", "__c")


@query("wn21_dispersion_momentum", f"{B}, {MOMENTUM} SELECT *, (fast_mom + slow_mom) / 2 AS blended_mom FROM mo", ["fast_mom", "slow_mom", "blended_mom"])
def momentum(spark, sf):
    """WN21: momentum of the implied rate at two horizons, and their mean."""
    return dispersion_momentum(bars(spark, sf)).select("series_id", "dt", "fast_mom", "slow_mom", "blended_mom")


_UNCLIPPED = _yz(21, clip=False)


@query("wn10_unclipped_and_pr16", f"{B}, {_E}, y AS (SELECT series_id, dt, iv, {_UNCLIPPED} AS rv FROM e) SELECT series_id, dt, rv, iv / nullif(rv * 100, 0) AS carry_over_vol FROM y", ["rv", "carry_over_vol"])
def unclipped(spark, sf):
    """WN10, PR16: the second estimator, which has no value where its variance is negative, and a carry over it."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    b = bars(spark, sf).withColumn("gap", F.log(o / lag(c)))
    rs = F.log(h / c) * F.log(h / o) + F.log(low / c) * F.log(low / o)
    v = roll(F.col("gap"), 21, F.var_samp) + _K(21) * roll(F.log(c / o), 21, F.var_samp) + (1 - _K(21)) * roll(rs, 21)
    b = b.withColumn("rv", F.sqrt(F.when(v >= 0, v) * 252) * 100)
    return b.select("series_id", "dt", "rv", (F.col("iv") / F.nullif(F.col("rv") * 100, F.lit(0.0))).alias("carry_over_vol"))

