"""Joins and spines in time: as-of joins, capped carries, business days, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, skip_null: bool = False, cap: int | None = None) -> DataFrame:
    """Adds `value` of the last right row at or before each left row, with one shuffle and no range join.

    skip_null passes over rows without a value; else the last row counts even if its value is null.  With a cap, a
    value is carried over at most so many later dates of both sides together; a date counts once, however many rows have it.
    """
    names = left.columns
    mine = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(f"struct<x:{right.schema[value].dataType.simpleString()}>"))
    r = right.select(*by, time, F.lit(0).alias("__side"), F.struct(F.col(value).alias("x")).alias("__v"))
    if skip_null:
        r = r.filter(F.col("__v.x").isNotNull())
    both = mine.unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(time, "__side")
    if cap is not None:
        both = both.withColumn("__d", F.dense_rank().over(W.partitionBy(*by).orderBy(time)))
        both = both.withColumn("__v", F.when(F.col("__v").isNotNull(), F.struct(F.col("__v.x").alias("x"), F.col("__d").alias("d"))))
    found = F.last("__v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    both = both.withColumn("__f", found)
    kept = F.col("__f.x") if cap is None else F.when(F.col("__d") - F.col("__f.d") <= cap, F.col("__f.x"))
    return both.withColumn(value, kept).filter("__side = 1").select(*names, value)


def business_days(keys: DataFrame, start: str, end: str) -> DataFrame:
    """keys x Monday-to-Friday days from start to end (columns)."""
    return keys.withColumn("dt", F.explode(F.sequence(F.col(start), F.col(end)))).filter(F.weekday("dt") < 5)


def folds(rows: DataFrame, train: int, test: int, step: int, least: int, key: str = "series_id", time: str = "dt") -> DataFrame:
    """Every row once for each walk-forward fold that holds it: rn (from 0), fold and part (train or test).

    Fold k trains on the `train` rows before row least + k * step (fewer in the first folds, `least` at least) and tests on
    the `test` rows from there; folds whose test rows aren't all there are left out.
    """
    w = W.partitionBy(key).orderBy(time)
    numbered = rows.withColumn("rn", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(key)))
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - test + 1 - least) / step))
    last = F.least(F.floor((F.col("rn") + train - least) / step), F.floor((F.col("__n") - test - least) / step))
    many = numbered.filter(first <= last).withColumn("fold", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return many.withColumn("part", F.when(F.col("rn") < F.col("fold") * step + least, "train").otherwise("test")).drop("__n")


def keyed_carry(rows: DataFrame, keys: list[str], key: str = "key", time: str = "dt", value: str = "value") -> DataFrame:
    """One row for each date that any of the named keys has, with each key's last value so far."""
    wanted = rows.filter(F.col(key).isin(*keys))
    spine = wanted.select(time).distinct().withColumn(key, F.explode(F.array(*map(F.lit, keys))))
    return asof(spine, wanted, [key], time, value, skip_null=True).groupBy(time).pivot(key, keys).agg(F.first(value))


def mixed_spine(rows: DataFrame, keys: list[str], start: Column, end: Column, back: int = 5, key: str = "key", time: str = "dt", value: str = "value") -> DataFrame:
    """Business days from start to end with the last value of each key, whatever its frequency; gaps at the begin are filled from the next `back` days at most."""
    ends = rows.filter(F.col(key).isin(*keys)).agg(start.alias("__a"), end.alias("__z"))
    days = business_days(ends, "__a", "__z").select(F.col("dt").alias(time), F.explode(F.array(*map(F.lit, keys))).alias(key))
    held = asof(days, rows.filter(F.col(key).isin(*keys)), [key], time, value, skip_null=True)
    ahead = W.partitionBy(key).orderBy(time).rowsBetween(0, back)
    return held.withColumn(value, F.first(value, ignorenulls=True).over(ahead)).groupBy(time).pivot(key, keys).agg(F.first(value))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the smallest `order` at which they stand."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))


def first_per_group(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")


def latest_fold(rows: DataFrame, keys: list[str], fold: str = "fold") -> DataFrame:
    """Of the rows of a key, those of the last fold."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(fold)))).filter("__r = 1").drop("__r")


def continuous(contracts: DataFrame, key: str = "series_id", contract: str = "contract", time: str = "dt", price: str = "close") -> DataFrame:
    """The rows of each contract until the next one starts, with `adjusted`: prices times the ratios of all later rolls.

    A roll's ratio is the next contract's first price over this one's last; the table of rolls has a row per contract.
    """
    of = W.partitionBy(key).orderBy(contract)
    starts = contracts.groupBy(key, contract).agg(F.min(time).alias("__start")).withColumn("__until", F.lead("__start").over(of)).drop("__start")
    front = contracts.join(starts, [key, contract]).filter(F.col("__until").isNull() | (F.col(time) < F.col("__until"))).drop("__until")
    ends = front.groupBy(key, contract).agg(F.min_by(price, time).alias("__first"), F.max_by(price, time).alias("__last"))
    ratio = F.coalesce(F.lead("__first").over(of) / F.nullif(F.col("__last"), F.lit(0.0)), F.lit(1.0))
    later = of.rowsBetween(0, W.unboundedFollowing)
    factors = ends.withColumn("__ratio", ratio).select(key, contract, F.product("__ratio").over(later).alias("__factor"))
    return front.join(factors, [key, contract]).withColumn("adjusted", F.col(price) * F.col("__factor")).drop("__factor")


# The normal quantile of 0.95, and the expansion of Student's quantile from it and the degrees of freedom.
Z95 = "CAST(1.6448536269514722 AS DOUBLE)"
T_QUANTILE = (
    "({z} + ({z} * {z} * {z} + {z}) / (4.0 * {nu}) + (5 * power({z}, 5) + 16 * power({z}, 3) + 3 * {z}) / (96.0 * {nu} * {nu})"
    " + (3 * power({z}, 7) + 19 * power({z}, 5) + 17 * power({z}, 3) - 15 * {z}) / (384.0 * {nu} * {nu} * {nu}))"
)


def rolling_fit(df: DataFrame, window: int, step: int, least: int = 30, key: str = "series_id", time: str = "dt", value: str = "close", year: float = 252.0) -> DataFrame:
    """The fit of changes on levels over the last `window` rows, every `step` rows, named by the window's last time.

    A row is in window / step windows at most, so rows are multiplied by that, and sums go by (key, window).
    """
    w = W.partitionBy(key).orderBy(time)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(key)))
    rows = rows.withColumns({"__x": F.lag(value).over(w), "__y": F.col(value) - F.lag(value).over(w)})
    # Window k ends at row window + k * step, before the last row.
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - window) / step))
    last = F.least(F.floor((F.col("__i") - 1) / step), F.ceil((F.col("__n") - window) / step) - 1)
    many = rows.filter(first <= last).withColumn("__k", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    # A window's first row has no row before it there.
    inner = F.col("__i") > F.col("__k") * step + 1
    x, y = F.when(inner, F.col("__x")), F.when(inner, F.col("__y"))
    s = many.groupBy(key, "__k").agg(
        F.max(time).alias(time), F.count(x).alias("n"), F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.covar_samp(y, x).alias("__c"), F.var_samp(x).alias("__vx"), F.var_samp(y).alias("__vy"),
    ).filter(F.col("n") >= least)
    slope, sse = F.col("slope"), (F.col("__vy") - F.col("slope") * F.col("slope") * F.col("__vx")) * (F.col("n") - 1)
    return s.withColumn("slope", F.col("__c") / F.col("__vx")).select(
        key, time, "n", "slope", (-slope * year).alias("kappa"), (-(F.col("__my") - slope * F.col("__mx")) / slope).alias("mu"), F.when(slope < 0, F.log(F.lit(2.0)) / -slope).alias("half_life"),
        F.sqrt(sse / (F.col("n") - 1)).alias("resid_std"), (slope / F.sqrt(sse / (F.col("n") - 2) / (F.col("__vx") * (F.col("n") - 1)))).alias("t_stat"),
    )
