"""Path-dependent operators as windows: positions with hysteresis, episodes, drawdowns, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.rolling import series


def running(w=None):
    return (w or series()).rowsBetween(W.unboundedPreceding, 0)


def hysteresis(df: DataFrame, z: Column, entry: float, leave: float, out: str = "position", sign: int = -1, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Adds -1, 0 or 1: enters when flat and |z| > entry, holds, leaves when |z| < leave; a null z gives 0 and keeps the state.

    sign is the position taken at z > entry.  Between two exits the first entry fixes the side, so the state is the first
    entry since the last exit.
    """
    if leave > entry:
        raise ValueError("leave must not exceed entry")
    df = df.withColumn("__z", z).withColumn("__g", F.sum(F.when(F.abs("__z") < leave, 1).otherwise(0)).over(running(W.partitionBy(*by).orderBy("dt"))))
    side = F.when(F.col("__z") > entry, sign).when(F.col("__z") < -entry, -sign)
    episode = W.partitionBy(*by, "__g").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    held = F.coalesce(F.first(side, ignorenulls=True).over(episode), F.lit(0))
    return df.withColumn(out, F.when(F.col("__z").isNull(), 0).otherwise(held)).drop("__z", "__g")


def episodes(df: DataFrame, x: Column, enter: float, leave: float) -> DataFrame:
    """One row per trade: opens when x > enter while flat, ends at the first later row with x < leave, or stays open."""
    w = series()
    rows = df.withColumn("__x", x).filter("__x is not null").withColumn("__g", F.sum(F.when(F.col("__x") < leave, 1).otherwise(0)).over(running()))
    first = W.partitionBy("series_id", "__g").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.min(F.when(F.col("__x") > enter, F.col("dt"))).over(first))
    rows = rows.withColumn("__next", F.lead(F.struct("dt", "close", "__g")).over(w))
    held = rows.filter("__in is not null")
    return held.groupBy("series_id", "__g").agg(
        F.min("__in").alias("entry_dt"), F.min_by("close", "dt").alias("entry_price"),
        F.max_by(F.coalesce(F.col("__next.dt"), F.col("dt")), "dt").alias("exit_dt"), F.max_by(F.coalesce(F.col("__next.close"), F.col("close")), "dt").alias("exit_price"),
        F.max_by(F.col("__next").isNull(), "dt").alias("still_open"), (F.count(F.lit(1)) - F.max(F.col("__next").isNull().cast("int"))).alias("duration"),
    ).drop("__g")


def drawdown(x: Column) -> Column:
    """Running sum of x less its running maximum."""
    return x - F.max(x).over(running())


def run_length(df: DataFrame, flag: Column, out: str = "run") -> DataFrame:
    """Adds how many rows in a row have had the flag, up to each row."""
    rows = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__g", F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(running()))
    return rows.withColumn(out, F.sum(F.col("__f").cast("long")).over(running(W.partitionBy("series_id", "__g").orderBy("dt")))).drop("__f", "__g")


def longest_run(df: DataFrame, flag: Column) -> DataFrame:
    """series_id and the length of its longest run of rows with the flag."""
    rows = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__g", F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(running()))
    runs = rows.groupBy("series_id", "__g").agg(F.sum(F.col("__f").cast("long")).alias("n"))
    return runs.groupBy("series_id").agg(F.max("n").alias("longest"))
