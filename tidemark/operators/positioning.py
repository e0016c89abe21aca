"""Positioning scores: risk reversals, trend and net positions of a series, as one number from -50 to 50."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.indicators import rsi_simple
from tidemark.operators.rolling import fill, lag, roll, rolling_rank, zscore

# Coefficients of the rational approximation of the normal quantile (relative error below 1.2e-9), highest
# power first: numerator and denominator of the middle, then of the tails, and where the tails begin.
MIDDLE = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0),
)
TAILS = (
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0),
)
TAIL = 0.02425


def _ratio(parts: tuple, x: str) -> str:
    made = []
    for part in parts:
        text = f"{part[0]!r}"
        for a in part[1:]:
            text = f"({text} * {x} + {a!r})"
        made.append(text)
    return f"{made[0]} / {made[1]}"


def normal_quantile(p: str) -> str:
    """SQL text, for a share p between 0 and 1, of the standard normal value with that share below it."""
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"CASE WHEN {p} < {TAIL} THEN {_ratio(TAILS, low)} WHEN {p} > {1 - TAIL} THEN -({_ratio(TAILS, high)}) ELSE ({p} - 0.5) * {_ratio(MIDDLE, f'(({p} - 0.5) * ({p} - 0.5))')} END"


def scores(df: DataFrame, window: int = 252, level: int = 1260, change: int = 20, share: float = 0.8, cap: int = 3) -> DataFrame:
    """Adds rr, trend, net_score, composite and score to (series_id, dt, spot, rr_short, rr_long, net).

    The three pillars weigh a third each and must all be there; gaps of up to `cap` rows are filled.  rr: 0.4 and 0.6 of
    the z-scores of short and long risk reversals.  trend: the mean of the z-scores of RSI and of the distances to means
    of 20 and 100 rows that there are.  net_score: 0.7 of the normal value of the level's rank over `level` rows and 0.3
    of the z-score of its change.  score: the composite's rank over `window` rows, from -50 to 50.
    """
    least, z = int(window * share), lambda x: zscore(x, window, int(window * share))
    df = df.withColumns({f"__{c}": fill(F.col(c), cap) for c in ("spot", "rr_short", "rr_long", "net")})
    df = df.withColumn("d", F.col("__spot") - lag(F.col("__spot")))
    df = df.withColumns({"__rsi": rsi_simple(), "__d20": F.col("__spot") - roll(F.col("__spot"), 20), "__d100": F.col("__spot") - roll(F.col("__spot"), 100), "__chg": F.col("__net") - lag(F.col("__net"), change)})
    df = rolling_rank(df, "__net", level, "__rank", int(level * share))
    df = df.withColumn("__p", F.when(F.col("__rank").isNotNull(), F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("__rank")))))
    df = df.withColumns({f"__z{c}": z(F.col(f"__{c}")) for c in ("rr_short", "rr_long", "rsi", "d20", "d100", "chg")})
    df = df.withColumns({"rr": 0.4 * F.col("__zrr_short") + 0.6 * F.col("__zrr_long"), "trend": mean_of("__zrsi", "__zd20", "__zd100")})
    df = df.withColumn("net_score", 0.7 * F.when(F.col("__p").isNotNull(), F.expr(normal_quantile("__p"))) + 0.3 * F.col("__zchg"))
    df = df.withColumn("composite", (F.col("rr") + F.col("trend") + F.col("net_score")) / 3)
    df = rolling_rank(df, "composite", window, "__share", least).withColumn("score", (F.col("__share") - 0.5) * 100)
    return df.drop("d", *(c for c in df.columns if c.startswith("__")))


def mean_of(*columns: str) -> Column:
    """The mean of the columns that are not null."""
    held = [F.col(c).isNotNull().cast("int") for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    return total / F.nullif(sum(held, F.lit(0)), F.lit(0))


def against(scored: DataFrame) -> DataFrame:
    """dt and score of what all series are quoted against: minus the mean of theirs."""
    return scored.groupBy("dt").agg((-F.avg("score")).alias("score"))
