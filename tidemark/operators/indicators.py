"""Technical indicators and volatility estimators over bars (series_id, dt, open, high, low, close)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ewm import Mean, ewms, span
from tidemark.operators.rolling import lag, roll


def change() -> Column:
    return F.col("close") - lag(F.col("close"))


def rsi(df: DataFrame, n: int = 14, adjust: bool = True, out: str = "rsi", least: int = 1) -> DataFrame:
    """100 - 100 / (1 + gain / loss) with exponentially weighted gains and losses; null where the loss is zero."""
    return rsis(df, {out: adjust}, n, least)


def _rsi_means(adjusted: Mapping[str, bool], n: int, least: int) -> dict[str, Mean]:
    d = F.col("__d")
    up, down = F.greatest(d, F.lit(0.0)) + d * 0, F.greatest(-d, F.lit(0.0)) + d * 0
    return {f"__{side}_{k}": Mean(x, 1 / n, adjust, least) for k, adjust in adjusted.items() for side, x in (("gain", up), ("loss", down))}


def _rsi_values(df: DataFrame, names: Iterable[str]) -> DataFrame:
    names = list(names)
    df = df.withColumns({k: 100 - 100 / (1 + F.col(f"__gain_{k}") / F.nullif(F.col(f"__loss_{k}"), F.lit(0.0))) for k in names})
    return df.drop("__d", *(f"__{side}_{k}" for k in names for side in ("gain", "loss")))


def rsis(df: DataFrame, adjusted: Mapping[str, bool], n: int = 14, least: int = 1) -> DataFrame:
    """One RSI for each name, adjusted or not, in one pass."""
    return _rsi_values(ewms(df.withColumn("__d", change()), _rsi_means(adjusted, n, least)), adjusted)


def rsi_simple(n: int = 14) -> Column:
    """RSI of plain rolling means; 100 where the loss is zero but the gain is not."""
    d = F.col("d")
    gain, loss = roll(F.greatest(d, F.lit(0.0)) + d * 0, n), roll(F.greatest(-d, F.lit(0.0)) + d * 0, n)
    return F.when(loss > 0, 100 - 100 / (1 + F.try_divide(gain, loss))).when(gain > 0, 100.0)


# MACD and ADX are means of means: what is averaged first, what is made of it, and what is averaged then.  technical() takes
# the first level of all indicators in one pass over a series, and the second in another.
def _macd_first(fast: int = 12, slow: int = 26) -> dict[str, Mean]:
    return {"__fast": Mean(F.col("close"), span(fast), False), "__slow": Mean(F.col("close"), span(slow), False)}


def _macd_line(df: DataFrame) -> DataFrame:
    return df.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")


def _macd_second(signal: int = 9) -> dict[str, Mean]:
    return {"macd_signal": Mean(F.col("macd"), span(signal), False)}


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewms(_macd_line(ewms(df, _macd_first(fast, slow))), _macd_second(signal))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, dev = roll(F.col("close"), n), roll(F.col("close"), n, F.stddev_samp)
    return {"bb_mid": mid, "bb_upper": mid + k * dev, "bb_lower": mid - k * dev, "bb_pct": (F.col("close") - (mid - k * dev)) / F.nullif(2 * k * dev, F.lit(0.0)), "bb_width": 2 * k * dev / mid}


def _adx_moves(df: DataFrame) -> DataFrame:
    h, low, before = F.col("high"), F.col("low"), lag(F.col("close"))
    up, down = F.greatest(h - lag(h), F.lit(0.0)) + lag(h) * 0, F.greatest(lag(low) - low, F.lit(0.0)) + lag(low) * 0
    df = df.withColumns({"__up": up, "__dn": down, "__tr": F.greatest(h - low, F.abs(h - before), F.abs(low - before))})
    df = df.withColumn("__p", F.when(F.col("__up") > F.col("__dn"), F.col("__up")).when(F.col("__up").isNotNull(), 0.0))
    return df.withColumn("__m", F.when(F.col("__dn") > F.col("__p"), F.col("__dn")).when(F.col("__dn").isNotNull(), 0.0))


def _adx_first(n: int, least: int) -> dict[str, Mean]:
    return {out: Mean(F.col(x), 1 / n, True, least) for x, out in (("__tr", "__atr"), ("__p", "__ps"), ("__m", "__ms"))}


def _adx_index(df: DataFrame) -> DataFrame:
    plus, minus = (100 * F.col(c) / F.nullif(F.col("__atr"), F.lit(0.0)) for c in ("__ps", "__ms"))
    df = df.withColumns({"__pd": plus, "__md": minus})
    df = df.withColumn("__dx", 100 * F.abs(F.col("__pd") - F.col("__md")) / F.nullif(F.col("__pd") + F.col("__md"), F.lit(0.0)))
    return df.drop("__up", "__dn", "__tr", "__p", "__m", "__atr", "__ps", "__ms", "__pd", "__md")


def _adx_second(n: int, least: int) -> dict[str, Mean]:
    return {"adx": Mean(F.col("__dx"), 1 / n, True, least)}


def adx(df: DataFrame, n: int = 14, least: int = 1) -> DataFrame:
    """ADX with the asymmetric tie rule: -DM is compared with +DM after that has been zeroed."""
    return ewms(_adx_index(ewms(_adx_moves(df), _adx_first(n, least))), _adx_second(n, least)).drop("__dx")


def estimators(n: int = 21, year: float = 252.0) -> dict[str, Column]:
    """Annualised volatilities in percent: close-to-close, Parkinson, Garman-Klass, Rogers-Satchell, Yang-Zhang."""
    o, h, low, before = F.col("open"), F.col("high"), F.col("low"), lag(F.col("close"))
    hl, co = F.log(h / low), F.log(F.col("close") / o)
    rs = F.log(h / F.col("close")) * F.log(h / o) + F.log(low / F.col("close")) * F.log(low / o)
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    gap = F.col("gap")
    scale = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) * year) * 100
    yz = roll(gap, n, F.var_samp) + k * roll(co, n, F.var_samp) + (1 - k) * roll(rs, n)
    return {
        "vol_cc": roll(F.col("r"), n, F.stddev_samp) * math.sqrt(year) * 100, "vol_parkinson": scale(roll(hl * hl, n) / (4 * math.log(2))),
        "vol_gk": scale(roll(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, n)), "vol_rs": scale(roll(rs, n)), "vol_yz": F.when(yz.isNotNull(), scale(yz)),
    }


def rsi_zone(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").when(x >= 70, "Overbought").when(x <= 30, "Oversold").otherwise("Neutral")


def adx_strength(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").when(x >= 40, "Strong").when(x >= 25, "Trending").otherwise("Weak")


def cross_label(fast: Column, slow: Column) -> Column:
    return F.when(fast.isNull() | slow.isNull(), "N/A").when(fast > slow, "Bull").when(fast < slow, "Bear").otherwise("Flat")


def histogram_direction(now: Column, before: Column) -> Column:
    """Up or down as it grows on its side of zero, ~ as it shrinks; needs two values."""
    return (
        F.when(now.isNull() | before.isNull(), "N/A").when((now > 0) & (now > before), "Bullish \u2191").when((now < 0) & (now < before), "Bearish \u2193")
        .when(now > 0, "Bullish ~").when(now < 0, "Bearish ~").otherwise("Neutral")
    )


def technical(df: DataFrame) -> DataFrame:
    """Adds every column of the technical board to bars; windows and means all run over the same series order.

    The means of RSI, MACD and ADX are taken in two passes over a series, one a level.
    """
    close = F.col("close")
    df = ewms(_adx_moves(df.withColumn("__d", change())), _rsi_means({"rsi_14": True}, 14, 14) | _macd_first() | _adx_first(14, 14))
    df = ewms(_adx_index(_macd_line(_rsi_values(df, ["rsi_14"]))), _macd_second() | _adx_second(14, 14))
    df = df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__dx").withColumnRenamed("adx", "adx_14")
    df = df.withColumns({"sma_20": roll(close, 20), "sma_50": roll(close, 50), "sma_200": roll(close, 200), "bb_pct_b": bollinger()["bb_pct"], "hist_before": lag(F.col("macd_hist"))})
    df = df.withColumns({f"roc_{k}": (close / F.nullif(lag(close, n), F.lit(0.0)) - 1) * 100 for k, n in (("1m", 21), ("3m", 63))})
    df = df.withColumns({f"zscore_{k}": (close - roll(close, n)) / F.nullif(roll(close, n, F.stddev_samp), F.lit(0.0)) for k, n in (("1m", 21), ("3m", 63), ("1y", 252))})
    return df.withColumns({
        "rsi_zone": rsi_zone(F.col("rsi_14")), "macd_signal": histogram_direction(F.col("macd_hist"), F.col("hist_before")), "adx_strength": adx_strength(F.col("adx_14")),
        "sma_20_50": cross_label(F.col("sma_20"), F.col("sma_50")), "sma_50_200": cross_label(F.col("sma_50"), F.col("sma_200")),
    })
