"""Rolling, expanding and rank windows over keyed series.

A rolling window counts rows; it has a value once `least` of them are not null.  Windows are partitioned by the series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY, TIME = "series_id", "dt"


def series(key: str = KEY, time: str = TIME):
    return W.partitionBy(key).orderBy(time)


def roll(x: Column, n: int, agg: Callable[[Column], Column] = F.avg, least: int | None = None, w=None) -> Column:
    """agg over the last n rows, where `least` (n) of them have a value."""
    over = (w or series()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(over) >= (n if least is None else least), agg(x).over(over))


def zscore(x: Column, n: int, least: int | None = None, w=None) -> Column:
    return (x - roll(x, n, F.avg, least, w)) / F.nullif(roll(x, n, F.stddev_samp, least, w), F.lit(0.0))


def lag(x: Column, n: int = 1, w=None) -> Column:
    return F.lag(x, n).over(w or series())


def log_return(x: Column, n: int = 1, w=None) -> Column:
    return F.log(x / lag(x, n, w))


def realised_vol(x: Column, n: int, year: float = 252.0, w=None) -> Column:
    """Annualised rolling deviation of log returns, in percent; x holds the returns."""
    return roll(x, n, F.stddev_samp, w=w) * F.sqrt(F.lit(year)) * 100


def autocorr(x: Column, before: Column, n: int, k: int = 1, w=None) -> Column:
    """Correlation of x with its k-th lag inside windows of n rows; `before` is that lag."""
    over = (w or series()).rowsBetween(-(n - 1 - k), 0)
    return F.when(F.count(F.when(x.isNotNull() & before.isNotNull(), 1)).over(over) >= n - k, F.corr(x, before).over(over))


def window_counts(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each value (NaN: none): how many of the last n are smaller, how many are equal, and how many there are, itself included.

    Values become their ranks.  From the highest bit of the ranks on, values are parted by each bit, which leaves a window
    two windows, one in each part; those with a smaller bit than the value's are smaller.  So it takes the bits of a rank,
    whatever n is.
    """
    there = ~np.isnan(values)
    rank = np.zeros(len(values), np.int64)
    known, rank[there] = np.unique(values[there], return_inverse=True)
    rank[~there] = len(known)
    hi = np.arange(1, len(values) + 1)
    lo = np.maximum(0, hi - n)
    total = np.concatenate([[0], np.cumsum(there)])
    less, x, v = np.zeros(len(values), np.int64), rank, rank
    a, b = lo, hi
    for bit in range(int(len(known)).bit_length() - 1, -1, -1):
        one = (v >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        up = (x >> bit & 1).astype(bool)
        less += np.where(up, zeros[b] - zeros[a], 0)
        a, b = np.where(up, zeros[-1] + a - zeros[a], zeros[a]), np.where(up, zeros[-1] + b - zeros[b], zeros[b])
        v = np.concatenate([v[~one], v[one]])
    # What is left of a window has the value's own rank.
    return np.where(there, less, 0), np.where(there, b - a, 0), total[hi] - total[lo]


def rolling_rank(df: DataFrame, x: str, n: int, out: str, least: int = 1, below: bool = False, key: str = KEY, time: str = TIME, size: int = 1 << 14) -> DataFrame:
    """Adds the average rank of x among the last n rows as a share, or with `below` the percentage of the n - 1 rows before that are less.

    Nulls have no rank and don't count; ties share their ranks; there is a value once `least` rows have one (with `below`,
    of the rows before).  A series is cut into blocks of `size` rows, each with the last n - 1 rows of the one before, so a
    task holds a block, and a row costs the bits of a rank and no list.  Places come from the column __place, if there is
    one (as from hot.placed), else from the order of the series.
    """
    size = max(size, n)
    given = "__place" in df.columns
    rows = df if given else df.withColumn("__place", F.row_number().over(series(key, time)) - 1)
    own = F.floor(F.col("__place") / size)
    copied = F.when(F.col("__place") % size >= size - (n - 1), F.array(own, own + 1)).otherwise(F.array(own)) if n > 1 else F.array(own)
    many = rows.withColumn("__b", F.explode(copied))
    schema = many.withColumn(out, F.lit(None).cast("double")).schema

    def ranks(table: pa.Table) -> pa.Table:
        table = table.sort_by("__place")
        values = table.column(x).cast(pa.float64()).to_numpy()
        less, same, seen = window_counts(values, n)
        there = ~np.isnan(values)
        if below:
            seen = seen - there
            share, ok = 100.0 * less / np.maximum(seen, 1), seen >= max(1, least)
        else:
            share, ok = (less + (same + 1) / 2) / np.maximum(seen, 1), there & (seen >= least)
        return table.append_column(out, pa.array(share, mask=~ok))

    found = many.groupBy(key, "__b").applyInArrow(ranks, schema).filter(F.floor(F.col("__place") / size) == F.col("__b")).drop("__b")
    return found if given else found.drop("__place")


def forward_mean(x: Column, n: int) -> Column:
    """Mean of the next n rows, where all have values."""
    over = series().rowsBetween(1, n)
    return F.when(F.count(x).over(over) == n, F.avg(x).over(over))


def fill(x: Column, cap: int | None = None, back: bool = False, w=None) -> Column:
    """The last (or next) value, if at most `cap` rows away."""
    w = w or series()
    far = cap if cap is not None else (W.unboundedFollowing if back else -W.unboundedPreceding)
    span = w.rowsBetween(0, far) if back else w.rowsBetween(-far, 0)
    return (F.first if back else F.last)(x, ignorenulls=True).over(span)


def zscore_by_length(df: DataFrame, x: str, length: str, out: str = "z") -> DataFrame:
    """Adds the z-score over each series' own number of rows, where half of them have values.

    Sums over the last n rows are differences of running sums, which are of values less the series' mean, so that little
    is lost in them; the running sums of n rows before come by an equality join.
    """
    w = series()
    df = df.withColumn("__i", F.row_number().over(w)).withColumn("__d", F.col(x) - F.avg(x).over(W.partitionBy(KEY)))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    zero = F.lit(0.0)
    df = df.withColumns({"__c": F.count("__d").over(upto), "__s": F.coalesce(F.sum("__d").over(upto), zero), "__q": F.coalesce(F.sum(F.col("__d") * F.col("__d")).over(upto), zero)})
    old = df.select(F.col(KEY).alias("__k0"), F.col("__i").alias("__i0"), F.col("__c").alias("__c0"), F.col("__s").alias("__s0"), F.col("__q").alias("__q0"))
    j = df.join(old, (F.col(KEY) == F.col("__k0")) & (F.col("__i") - F.col(length) == F.col("__i0")), "left")
    n, s, q = (F.col(a) - F.coalesce(F.col(b), F.lit(0)) for a, b in (("__c", "__c0"), ("__s", "__s0"), ("__q", "__q0")))
    mean = s / n
    deviation = F.sqrt(F.greatest((q - n * mean * mean) / F.nullif(n - 1, F.lit(0)), zero))
    z = F.when(n >= F.floor(F.col(length) / 2), (F.col("__d") - mean) / F.nullif(deviation, zero))
    return j.withColumn(out, z).drop("__i", "__d", "__c", "__s", "__q", "__k0", "__i0", "__c0", "__s0", "__q0")


def expanding_rank(df: DataFrame, x: str, out: str, block: int = 1024) -> DataFrame:
    """Adds the average rank of a value among all values of its series so far, as a share; null where there is no value.

    A value is ranked by how many before it in time are smaller, and as many equal.  Rows have a place in time and one by
    value; both orders are cut into blocks.  Those of earlier blocks in both orders come from running sums over the grid
    of blocks; those of the own block in either order from a list of one block.  So a row needs two blocks, not its past.
    """
    has = F.col(x).isNotNull()
    rows = df.filter(has).withColumn("__t", F.row_number().over(series()) - 1).withColumn("__v", F.row_number().over(W.partitionBy(KEY).orderBy(x, TIME)) - 1)
    # Equal values share the place of the first of them.
    rows = rows.withColumn("__e", F.min("__v").over(W.partitionBy(KEY, x)))
    rows = rows.withColumns({"__a": F.floor(F.col("__t") / block), "__b": F.floor(F.col("__e") / block)})
    grid = rows.groupBy(KEY, "__a", F.floor(F.col("__e") / block).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    # Of each block in time: how many of the blocks before it lie in each block by value, summed from the smallest on.
    spine = grid.select(KEY, "__a").distinct().join(grid.select(KEY, "__g").distinct(), KEY).join(grid, [KEY, "__a", "__g"], "left")
    earlier = F.coalesce(F.sum("__n").over(W.partitionBy(KEY, "__g").orderBy("__a").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = F.coalesce(F.sum("__m").over(W.partitionBy(KEY, "__a").orderBy("__g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = spine.withColumn("__m", earlier).withColumn("__k", below).select(KEY, "__a", F.col("__g").alias("__b"), "__k")
    first, mine = F.col("__a") * block, F.col("__e")
    # A list is counted before the next one is made, so that no sort carries lists.
    in_time = F.collect_list(mine).over(W.partitionBy(KEY, "__a").orderBy("__t").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__s", F.size(F.filter(in_time, lambda e: e < mine)))
    # Many equal values may share a block, but no larger one is in it, so those beyond its places count for none.
    placed = F.when(F.floor(F.col("__v") / block) == F.col("__b"), F.struct(F.col("__t").alias("t"), mine.alias("e")))
    by_value = F.collect_list(placed).over(W.partitionBy(KEY, "__b"))
    rows = rows.withColumn("__s", F.col("__s") + F.size(F.filter(by_value, lambda r: (r["t"] < first) & (r["e"] < mine))))
    ranked = rows.withColumn("__w", F.row_number().over(W.partitionBy(KEY, x).orderBy(TIME)) - 1).join(sums, [KEY, "__a", "__b"])
    share = (F.col("__s") + F.col("__k") + (F.col("__w") + 2) / 2) / (F.col("__t") + 1)
    names = df.drop(out).columns
    return ranked.select(*names, share.alias(out)).unionByName(df.filter(~has).select(*names, F.lit(None).cast("double").alias(out)))
