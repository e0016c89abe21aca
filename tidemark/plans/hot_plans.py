"""Queries over prints as three hot series (one per return flag): windows, ranks, states and quantiles by blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hot, rolling
from tidemark.plans.registry import query
from tidemark.sources.views import PRINT_ORDER, table

_ID = ["series_id", "l_orderkey", "l_linenumber"]
_P = f"""WITH p AS (SELECT l_returnflag AS series_id, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS close, l_quantity AS volume,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY {', '.join(PRINT_ORDER)}) AS rn FROM lineitem)"""
_W = "(PARTITION BY series_id ORDER BY rn)"


def _roll(x: str, n: int, agg: str = "avg", least: int | None = None) -> str:
    over = f"OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {n if least is None else least} THEN {agg}({x}) {over} END"


def prints(spark, sf):
    """series_id (return flag), dt (a total order), close and volume of all prints."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), "l_orderkey", "l_linenumber", F.struct(*PRINT_ORDER).alias("dt"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.col("l_quantity").alias("volume")
    )


def placed(spark, sf, *columns):
    """The prints in their places, with these columns and the print's own number; the order by which they are sorted stays behind."""
    return hot.placed(prints(spark, sf), columns=["l_orderkey", "l_linenumber", *columns])


@query("wn1_wn16_hot_windows", f"""{_P}, r AS (SELECT *, ln(close / lag(close) OVER {_W}) AS r FROM p)
SELECT series_id, l_orderkey, l_linenumber, r AS log_return, {_roll('close', 50)} AS sma_50, (close - ({_roll('close', 60, 'avg', 30)})) / nullif({_roll('close', 60, 'stddev_samp', 30)}, 0) AS z, ({_roll('r', 20, 'stddev_samp')}) * sqrt(252::DOUBLE) * 100 AS rv_20 FROM r""",
    ["log_return", "sma_50", "z", "rv_20"], ())
def windows(spark, sf):
    """WN1, WN8, WN16, PR2 over hot series: means, deviations and returns in blocks with a halo."""
    c = F.col("close")
    steps = [
        lambda w: {"log_return": rolling.log_return(c, w=w)},
        lambda w: {"sma_50": rolling.roll(c, 50, w=w), "z": rolling.zscore(c, 60, 30, w), "rv_20": rolling.realised_vol(F.col("log_return"), 20, w=w)},
    ]
    return hot.in_blocks(placed(spark, sf, "close"), 60, steps).select(*_ID, "log_return", "sma_50", "z", "rv_20")


@query("wn20_hot_ranks", f"""{_P}, k AS (SELECT c.series_id, c.rn, (sum((p.close < c.close)::INT) + (sum((p.close = c.close)::INT) + 1) / 2.0) / count(*) AS pct FROM p c JOIN p ON p.series_id = c.series_id AND p.rn BETWEEN c.rn - 251 AND c.rn GROUP BY ALL)
SELECT series_id, l_orderkey, l_linenumber, CASE WHEN rn >= 252 THEN pct END AS rank_pct FROM k JOIN p USING (series_id, rn)""", ["rank_pct"], ())  # fmt: skip
def ranks(spark, sf):
    """WN20 over hot series: ranks among 252 rows."""
    return rolling.rolling_rank(placed(spark, sf, "close"), "close", 252, "rank_pct", 252).select(*_ID, "rank_pct")


@query("st1_hot_positions", f"""{_P}, z AS (SELECT *, (close - ({_roll('close', 60, 'avg', 30)})) / nullif({_roll('close', 60, 'stddev_samp', 30)}, 0) AS z FROM p),
g AS (SELECT *, sum((coalesce(abs(z) < 0.5, false))::INT) OVER {_W} AS g, CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 END AS side FROM z)
SELECT series_id, l_orderkey, l_linenumber, z, CASE WHEN z IS NULL THEN 0 ELSE coalesce(first_value(side IGNORE NULLS) OVER (PARTITION BY series_id, g ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) END AS position FROM g""", ["z"], ())  # fmt: skip
def positions(spark, sf):
    """ST1 over hot series: positions from maps of states, composed over blocks."""
    b = hot.in_blocks(placed(spark, sf, "close"), 60, [lambda w: {"z": rolling.zscore(F.col("close"), 60, 30, w)}], keep=True)
    return hot.hysteresis(b, F.col("z"), 1.5, 0.5).select(*_ID, "z", "position")


@query("wn31_hot_running", f"""{_P}, c AS (SELECT *, sum(volume) OVER {_W} AS volume_so_far, max(close) OVER {_W} AS top FROM p) SELECT series_id, l_orderkey, l_linenumber, volume_so_far, close - top AS drawdown FROM c""", ["volume_so_far", "drawdown"], ())
def running(spark, sf):
    """WN31 over hot series: running sums and drawdowns."""
    b = hot.running(placed(spark, sf, "close", "volume"), {"volume_so_far": ("sum", F.col("volume")), "top": ("max", F.col("close"))})
    return b.select(*_ID, "volume_so_far", (F.col("close") - F.col("top")).alias("drawdown"))


@query("wn32_hot_underwater", f"""{_P}, d AS (SELECT series_id, rn, close < max(close) OVER {_W} AS f FROM p), g AS (SELECT series_id, f, rn - row_number() OVER (PARTITION BY series_id, f ORDER BY rn) AS g FROM d)
SELECT series_id, coalesce(max(CASE WHEN f THEN n END), 0)::BIGINT AS longest FROM (SELECT series_id, f, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY series_id""", (), ())  # fmt: skip
def underwater(spark, sf):
    """WN32 over hot series: the longest run below the running maximum."""
    below = hot.drawdown(placed(spark, sf, "close"), F.col("close"))
    return hot.longest_run(below, F.col("drawdown") < 0)


@query("ag18_hot_quantiles", f"{_P} SELECT series_id, greatest(quantile_cont(abs(close - 1500), 0.85), 1e-6) AS lim, quantile_cont(close, 0.1) AS p10, quantile_cont(close, 0.9) AS p90 FROM p GROUP BY series_id", ["lim", "p10", "p90"], ())
def limits(spark, sf):
    """AG18 over hot series: exact quantiles from the ranges in which they lie."""
    p = prints(spark, sf).withColumn("off", F.abs(F.col("close") - 1500))
    lim = hot.quantiles(p, "off", [0.85]).select("series_id", F.greatest("q0", F.lit(1e-6)).alias("lim"))
    return lim.join(hot.quantiles(p, "close", [0.1, 0.9]).withColumnsRenamed({"q0": "p10", "q1": "p90"}), "series_id")
