"""Queries that fit models per series: a variance regression on three horizons, switching regimes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import regimes, rolling
from tidemark.operators.rolling import roll
from tidemark.plans import sqltext as S
from tidemark.plans.registry import query
from tidemark.plans.series_plans import B, bars

_X = ("d", "w", "m")


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_COV = [[f"c{p}{q}" for q in _X] for p in _X]
_BETA = {f"beta_{x}": f"{_det([[f'y{p}' if j == k else _COV[i][j] for j in range(3)] for i, p in enumerate(_X)])} / nullif({_det(_COV)}, 0)" for k, x in enumerate(_X)}
_MOMENTS = ", ".join([f"covar_samp({p}, {q}) AS c{p}{q}" for p, q in product(_X, _X)] + [f"covar_samp({p}, y) AS y{p}" for p in _X] + [f"avg({v}) AS a{v}" for v in (*_X, "y")])


_ROWS = f"""{B}, v AS (SELECT series_id, dt, r * r * 1e4::DOUBLE AS d, {S.roll('r * r * 1e4::DOUBLE', 5)} AS w, {S.roll('r * r * 1e4::DOUBLE', 22)} AS m, CASE WHEN count(r) OVER f = 5 THEN avg(r * r * 1e4::DOUBLE) OVER f END AS y
  FROM b WINDOW f AS (PARTITION BY series_id ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""
_FIT = f"""{_ROWS},
s AS (SELECT series_id, count(*) AS n, {_MOMENTS} FROM v WHERE d IS NOT NULL AND w IS NOT NULL AND m IS NOT NULL AND y IS NOT NULL GROUP BY series_id HAVING count(*) >= 30),
k AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _BETA.items())} FROM s), l AS (SELECT series_id, arg_max(d, dt) AS ld, arg_max(w, dt) AS lw, arg_max(m, dt) AS lm FROM v WHERE m IS NOT NULL GROUP BY series_id)
SELECT series_id, n, beta_d, beta_w, beta_m, ay - beta_d * ad - beta_w * aw - beta_m * am AS const, ay + beta_d * (ld - ad) + beta_w * (lw - aw) + beta_m * (lm - am) AS forecast FROM k JOIN l USING (series_id)"""


def variance_rows(spark, sf):
    """Variance of a day, the means of a week's and a month's, and of the next week's."""
    v = F.col("r") * F.col("r") * 1e4
    return bars(spark, sf).select("series_id", "dt", v.alias("d"), roll(v, 5).alias("w"), roll(v, 22).alias("m"), rolling.forward_mean(v, 5).alias("y"))


@query("ag5_variance_regression", _FIT, ["beta_d", "beta_w", "beta_m", "const", "forecast"], ())
def variance_regression(spark, sf):
    """AG5: forward variance on the last day's, week's and month's; one pass of moments per series, solved in place."""
    b = variance_rows(spark, sf)
    now = b.filter("m is not null").groupBy("series_id").agg(*(F.max_by(x, "dt").alias(f"l{x}") for x in _X))
    moments = [F.covar_samp(p, q).alias(f"c{p}{q}") for p, q in product(_X, _X)] + [F.covar_samp(p, "y").alias(f"y{p}") for p in _X] + [F.avg(x).alias(f"a{x}") for x in (*_X, "y")]
    s = b.na.drop(subset=[*_X, "y"]).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), *moments).filter("n >= 30")
    k = s.select("*", *(F.expr(e).alias(n) for n, e in _BETA.items())).join(now, "series_id")
    return k.selectExpr("series_id", "n", *_BETA, "ay - beta_d * ad - beta_w * aw - beta_m * am AS const", "ay + beta_d * (ld - ad) + beta_w * (lw - aw) + beta_m * (lm - am) AS forecast")


_FITTED = "const + beta_d * d + beta_w * w + beta_m * m"


@query("ag5_fitted_path", f"{_ROWS.replace('WITH', f'WITH fit AS ({_FIT}),', 1)} SELECT series_id, dt, y, {_FITTED} AS fitted, y - ({_FITTED}) AS residual FROM v JOIN fit USING (series_id) WHERE m IS NOT NULL AND d IS NOT NULL", ["y", "fitted", "residual"])
def fitted_path(spark, sf):
    """AG5: the fit's variance at every row that has the three means, and what it misses where the next week is known."""
    rows = variance_rows(spark, sf).filter("m is not null and d is not null").join(variance_regression(spark, sf), "series_id")
    return rows.select("series_id", "dt", "y", F.expr(_FITTED).alias("fitted"), (F.col("y") - F.expr(_FITTED)).alias("residual"))


@query("st13_switching_model")
def switching_model(spark, sf):
    """ST13: smoothed and filtered probabilities of three states with their own level, lag and deviation; no SQL can express the fit."""
    return regimes.switching_probs(bars(spark, sf).select("series_id", "dt", "r"), "r")


@query("st14_rolling_regimes")
def rolling_regimes(spark, sf):
    """ST14: the model refitted as the weeks go on, each fit carried over the weeks to the next."""
    b = bars(spark, sf).filter("r is not null").withColumn("rn", F.row_number().over(W.partitionBy("series_id").orderBy("dt")))
    return regimes.rolling_regimes(b.select("series_id", "dt", "rn", "r"), "r", 208, 26)
