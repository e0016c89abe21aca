"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places by floor(x * 1e6 + 0.5), and dates as text, so that two engines can be compared."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        cols.append((_floor(c * 1e6 + 0.5) / 1e6).alias(name) if kind == "double" else c.cast("string").alias(name) if kind == "date" else c)
    return df.select(*cols)


def _floor(x: Column) -> Column:
    """As a double: Spark's floor is a long, which holds neither large numbers nor NaN.  From 2 ** 53 on, doubles are whole."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), dates: Sequence[str] = ("dt",)):
    """Registers a query; the SQL's named columns are rounded, or made text, like the query's."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql is not None:
            made = [f"floor({c} * 1e6 + 0.5) / 1e6 AS {c}" for c in doubles] + [f"{c}::DATE::VARCHAR AS {c}" for c in dates]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(made)}) FROM ({sql}) AS q" if made else sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidemark.plans import align_plans, boards, event_plans, file_plans, fit_plans, hot_plans, monitor_plans, news_plans, pair_plans, positioning_plans, record_plans, series_plans, tag_plans, trade_plans, vol_plans, walk_plans  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
