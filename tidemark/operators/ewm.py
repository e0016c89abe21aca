"""Exponentially weighted means as blocked prefix sums: no row loop and no Python.

y[t] = d * y[t-1] + u[t] is a prefix sum once divided by d ** t, which would overflow on long series.  So rows are cut
into blocks of such a length that d to its power is e ** -REACH: inside a block the prefix sum is exact, and of what lies
before, only the end of the block before it counts, since older values weigh less than a double can show.  So a row
needs its block's sums and one carried value, however long the series is.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.rolling import KEY, TIME

REACH = 300.0


class Mean(NamedTuple):
    """An exponentially weighted mean of `x`: adjusted by the weights of the values seen, or started from the first value."""

    x: Column
    alpha: float
    adjust: bool = True
    least: int = 1


def span(n: float) -> float:
    return 2 / (n + 1)


def halflife(h: float) -> float:
    return 1 - math.exp(-math.log(2) / h)


def recurrences(df: DataFrame, inputs: Mapping[str, tuple[Column, float | Column]], key: str = KEY, time: str = TIME) -> DataFrame:
    """Adds y[t] = decay * y[t-1] + u[t] for each name's (u, decay), in the order of `time` within `key`; u isn't null.

    A decay lies between 0 and 1, or is 0, and y is u then; it may be a column that is the same for all rows of a key.
    Equal numbers share blocks.
    """
    gone = {name: F.lit(d == 0.0) if isinstance(d, float) else d == 0.0 for name, (_, d) in inputs.items()}
    at_once = {name: u for name, (u, _) in inputs.items()}
    half = F.lit(0.5)
    # Any decay does where none is used.
    safe = {id(d): F.when(d == 0.0, half).otherwise(d) for _, d in inputs.values() if not isinstance(d, float)}
    inputs = {name: (u, (d or 0.5) if isinstance(d, float) else safe[id(d)]) for name, (u, d) in inputs.items()}
    order = W.partitionBy(key).orderBy(time)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    decays = {d if isinstance(d, float) else id(d): F.lit(d) if isinstance(d, float) else d for _, d in inputs.values()}
    place = {d: k for k, d in enumerate(decays)}
    df = df.withColumn("__i", F.row_number().over(order) - 1)
    size = {d: F.greatest(F.lit(2), F.floor(REACH / -F.log(c))) for d, c in decays.items()}
    df = df.withColumns({f"__{part}{place[d]}": f for d, n in size.items() for part, f in (("b", F.floor(F.col("__i") / n)), ("o", F.col("__i") % n), ("e", F.col("__i") % n == n - 1))})
    sums = {}
    for name, (u, d) in inputs.items():
        of = d if isinstance(d, float) else id(d)
        k, c = place[of], decays[of]
        inside = W.partitionBy(key, f"__b{k}").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
        sums[f"__l_{name}"] = F.sum(u * F.pow(c, -F.col(f"__o{k}"))).over(inside) * F.pow(c, F.col(f"__o{k}"))
    df = df.withColumns(sums)
    out = {}
    for name, (_, d) in inputs.items():
        of = d if isinstance(d, float) else id(d)
        k, c = place[of], decays[of]
        carried = F.last(F.when(F.col(f"__e{k}"), F.col(f"__l_{name}")), ignorenulls=True).over(before)
        value = F.col(f"__l_{name}") + F.pow(c, F.col(f"__o{k}") + 1) * F.coalesce(carried, F.lit(0.0))
        out[name] = F.when(gone[name], at_once[name]).otherwise(value)
    return df.withColumns(out).drop("__i", *sums, *(f"__{part}{k}" for k in place.values() for part in "boe"))


def _seen(df: DataFrame, values: Mapping[str, Column], key: str, time: str) -> DataFrame:
    """Adds how many values there are so far, by name."""
    so_far = W.partitionBy(key).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({k: F.count(x).over(so_far) for k, x in values.items()})


def ewms(df: DataFrame, means: Mapping[str, Mean], key: str = KEY, time: str = TIME, seen=_seen, recur=recurrences) -> DataFrame:
    """Adds exponentially weighted means by name, all in one pass over the series.

    adjust=True divides by the weights of the values seen (nulls weigh nothing); adjust=False starts from the first
    value and expects none to be null after it.  Rows before `least` values are null.  `seen` and `recur` count values
    and solve recurrences; hot.ewms has those for series of any length.
    """
    df = df.withColumns({f"__x_{k}": m.x for k, m in means.items()})
    df = seen(df, {f"__n_{k}": F.col(f"__x_{k}") for k in means}, key, time)
    inputs: dict[str, tuple[Column, float]] = {}
    for k, m in means.items():
        x, decay = F.col(f"__x_{k}"), float(1 - m.alpha)
        if m.adjust:
            inputs[f"__s_{k}"] = F.coalesce(x, F.lit(0.0)), decay
            inputs[f"__w_{k}"] = F.when(x.isNotNull(), 1.0).otherwise(0.0), decay
        else:
            inputs[f"__s_{k}"] = F.coalesce(F.when(F.col(f"__n_{k}") == 1, x).otherwise(m.alpha * x), F.lit(0.0)), decay
    df = recur(df, inputs, key, time)
    value = {k: F.col(f"__s_{k}") / F.nullif(F.col(f"__w_{k}"), F.lit(0.0)) if m.adjust else F.col(f"__s_{k}") for k, m in means.items()}
    df = df.withColumns({k: F.when(F.col(f"__n_{k}") >= max(1, m.least), value[k]) for k, m in means.items()})
    return df.drop(*(f"__{part}_{k}" for k in means for part in "xnsw"))


def ewm(df: DataFrame, x: Column, out: str, alpha: float, adjust: bool = True, least: int = 1, key: str = KEY, time: str = TIME) -> DataFrame:
    """Adds one exponentially weighted mean."""
    return ewms(df, {out: Mean(x, alpha, adjust, least)}, key, time)
