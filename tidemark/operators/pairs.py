"""Pairs of currencies: splitting, restating, leg differentials, labels, trend scores and their crosses."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ewm import Mean, ewms, halflife
from tidemark.operators.rolling import lag, roll

# Half-lives (short, long) of the trend's horizons, and the response's scale.
HORIZONS = ((8, 24), (16, 48), (32, 96))
SCALE = 0.89
# Labels of a policy bias.
BIAS = {1: "Hawkish", 0: "Neutral", -1: "Dovish"}


def split(pair: Column) -> tuple[Column, Column]:
    """Base and quote of a pair of two three-letter codes."""
    return F.substring(pair, 1, 3), F.substring(pair, 4, 3)


def to_base(pair: Column, price: Column, base: str = "USD") -> tuple[Column, Column]:
    """Name and price of a pair restated so that `base` comes first; a price of zero has no inverse."""
    one, two = split(pair)
    return F.when(one == base, pair).otherwise(F.concat(two, one)), F.when(one == base, price).otherwise(1 / F.nullif(price, F.lit(0.0)))


def by_bands(x: Column, bands: Sequence[tuple[str, float, str]], rest: str, missing: str = "N/A") -> Column:
    """The label of the first (comparison, limit, label) that holds; `missing` of a null."""
    out = F.when(x.isNull(), missing)
    tests = {">": x.__gt__, ">=": x.__ge__, "<": x.__lt__, "<=": x.__le__}
    for op, limit, label in bands:
        out = out.when(tests[op](limit), label)
    return out.otherwise(rest)


def composite_signal(diff: Column) -> Column:
    return by_bands(diff, ((">", 2, "Strong Bull"), (">", 0, "Mild Bull"), ("<", -2, "Strong Bear"), ("<", 0, "Mild Bear")), "Neutral")


def vol_regime(vol: Column, mean: Column) -> Column:
    """High or low if beyond 1.3 or under 0.7 times its mean."""
    return by_bands(vol / F.nullif(mean, F.lit(0.0)), ((">", 1.3, "High"), ("<", 0.7, "Low")), "Normal")


def roles(pairs: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Pairs (base, quote) with the dimension's columns twice, as b_ and q_; a pair keeps its row if a leg is unknown."""
    out = pairs
    for role, name in (("b", "base"), ("q", "quote")):
        side = dim.select(F.col(key).alias(f"__{role}"), *(F.col(c).alias(f"{role}_{c}") for c in dim.columns if c != key))
        out = out.join(side, F.col(name) == F.col(f"__{role}"), "left").drop(f"__{role}")
    return out


def leg_differential(base: Column, quote: Column, base_value: Column, quote_value: Column, anchor: str = "USD") -> Column:
    """The other currency less the anchor where the pair has it, else base less quote."""
    return F.when(base == anchor, quote_value - base_value).otherwise(base_value - quote_value)


def bias_text(base: Column, quote: Column) -> Column:
    name = F.create_map(*(F.lit(x) for kv in BIAS.items() for x in kv))
    return F.concat(F.coalesce(F.try_element_at(name, base), F.lit("N/A")), F.lit(" vs "), F.coalesce(F.try_element_at(name, quote), F.lit("N/A")))


def surprise(actual: Column, consensus: Column, deviation: Column) -> Column:
    """How many deviations a release is off its consensus; 0 where the deviation is 0."""
    return F.when(deviation == 0, 0.0).otherwise((actual - consensus) / F.nullif(deviation, F.lit(0.0)))


def trend_score(df: DataFrame, price: Column, damp: bool = True, vol: int = 63, signal: int = 252, horizons: Sequence[tuple[int, int]] = HORIZONS, out: str = "score") -> DataFrame:
    """Adds the mean over horizons of a damped (or clipped) trend: short less long mean of log prices, scaled twice."""
    df = df.withColumn("__lp", F.log(price))
    lp = F.col("__lp")
    df = ewms(df, {f"__m{h}": Mean(lp, halflife(h), True, h) for h in sorted({h for pair in horizons for h in pair})})
    df = df.withColumn("__v", F.nullif(roll(lp, vol, F.stddev_samp), F.lit(0.0)))
    df = df.withColumns({f"__y{k}": (F.col(f"__m{s}") - F.col(f"__m{l}")) / F.col("__v") for k, (s, l) in enumerate(horizons)})
    df = df.withColumns({f"__z{k}": F.col(f"__y{k}") / F.nullif(roll(F.col(f"__y{k}"), signal, F.stddev_samp), F.lit(0.0)) for k in range(len(horizons))})
    response = lambda z: z * F.exp(-z * z / 4) / SCALE if damp else F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z)) / 2 + z * 0
    parts = [response(F.col(f"__z{k}")) for k in range(len(horizons))]
    made = [c for c in df.columns if c.startswith("__")]
    return df.withColumn(out, sum(parts[1:], parts[0]) / len(parts)).drop(*made)


def cross_scores(scores: DataFrame, pairs: DataFrame, code: str = "code", time: str = "dt", score: str = "score") -> DataFrame:
    """base, quote, dt and score of pairs from the scores of their legs against one base: half of quote's less base's."""
    one = scores.select(F.col(code).alias("base"), time, F.col(score).alias("__b"))
    two = scores.select(F.col(code).alias("quote"), time, F.col(score).alias("__q"))
    return pairs.join(one, "base").join(two, ["quote", time]).select("base", "quote", time, ((F.col("__q") - F.col("__b")) / 2).alias(score))


def vol_target(score: Column, log_return: Column, target: float = 0.10, window: int = 63, cap: float = 2.0, year: float = 252.0) -> Column:
    """Yesterday's score over the annualised deviation, at most `cap` either way."""
    vol = roll(log_return, window, F.stddev_samp) * math.sqrt(year)
    raw = lag(score) * target / F.nullif(vol, F.lit(0.0))
    return F.when(raw.isNotNull(), F.greatest(F.lit(-cap), F.least(F.lit(cap), raw)))


def issuers(pairs: DataFrame, order: str, dim: DataFrame, currency: str, issuer: str) -> DataFrame:
    """Issuers of the currencies of all pairs in the order in which their currencies are seen first, each once."""
    legs = pairs.select(F.col(order).alias("__o"), F.posexplode(F.array("base", "quote")).alias("__p", "__c"))
    seen = legs.groupBy("__c").agg(F.min(F.struct("__o", "__p")).alias("__first"))
    met = seen.join(dim.select(F.col(currency).alias("__c"), F.col(issuer).alias("issuer")), "__c")
    return met.groupBy("issuer").agg(F.min(F.struct("__first", "__c")).alias("__m")).select("issuer", F.col("__m.__c").alias("currency"), F.col("__m.__first.__o").alias("seen"))


def latest_change(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The last value of each key and its change on the one before; nulls are passed over."""
    w = W.partitionBy(key).orderBy(F.desc(time))
    rows = df.filter(F.col(value).isNotNull()).select(key, value, F.lead(value).over(w).alias("__before"), F.row_number().over(w).alias("__r")).filter("__r = 1")
    return rows.select(key, value, (F.col(value) - F.col("__before")).alias("change"))
