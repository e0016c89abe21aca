"""Canonical series over the star-schema tables: bars, implied vols, prints, low-frequency series, news, headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order of prints.
PRINT_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (brand), ts, price, volume and ord (a total order)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("series_id"))
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        "series_id", F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        (F.col("l_discount") + F.col("l_tax")).alias("load"), F.struct(*PRINT_ORDER).alias("ord"),
    )


def bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """series_id, dt, open, high, low, close, volume and iv."""
    dt = F.to_date(F.date_trunc(unit, "ts")).alias("dt")
    return prints(spark, sf_dir).groupBy("series_id", dt).agg(
        F.min_by("price", "ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ord").alias("close"),
        F.sum("volume").alias("volume"), (5 + 100 * F.avg("load")).alias("iv"),
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name (priority), dt (month), value."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("dt")).agg(F.avg("o_totalprice").alias("value"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (event type), ts, price."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("price"), "event_id")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, event_class, direction, tier, confidence, is_override."""
    names = F.array(*map(F.lit, ("hawkish", "dovish", "neutral")))
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("event_class"), F.element_at(names, (F.col("user_id") % 3 + 1).cast("int")).alias("direction"),
        (F.col("event_id") % 5 + 1).cast("int").alias("tier"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), (F.col("event_id") % 50 == 0).alias("is_override"),
    )
