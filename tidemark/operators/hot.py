"""Series of any length: places, rolling windows, running values and states, and quantiles, without a task that holds a series.

Rows are laid out once by ranges of (key, time), which Spark samples, so a hot series lies in many partitions.  They are
written sorted, each with its number in its range; what earlier ranges hold of its series makes that its place in the series,
without another shuffle.  Places are cut into blocks of `ROWS`, and

- a rolling window needs the last rows of the block before: they are copied into the next block (`in_blocks`);
- a running value is that of the block, combined with what the blocks before it come to (`running`);
- a recurrence y[t] = d * y[t-1] + u[t] adds to a block's own values what it is entered with, decayed (`recurrences`, `ewms`);
- a position with hysteresis maps the state in which a block is entered to the one in which it is left: a block with an
  exit forgets how it was entered, another keeps a position, and opens its own first entry if there was none.  These maps
  are composed over the blocks of a series, and each block starts from what they give (`hysteresis`).

Tables of blocks have one row per series and ROWS rows, so windows over the blocks of one series stay small.  They are made
first, and broadcast if they are found to have BROADCAST_ROWS at most, so that rows are not dealt again to meet them.  Results are
those of the windows over whole series in `rolling` and `state`, but for the order in which doubles are summed in running sums.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.operators import ewm
from tidemark.operators.rolling import KEY, TIME
from tidemark.sources import scratch

#: Rows of a block.
ROWS = 1 << 16
PLACE = "__place"
#: Rows of a table of blocks or ranges that is broadcast at most; beyond it, a join does the same.
BROADCAST_ROWS = 200_000


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = scratch.folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame) -> DataFrame:
    """The table, made now, to be broadcast if it has few rows."""
    table = settled(table)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def laid(df: DataFrame, *order: str) -> DataFrame:
    """The rows as a table in ranges of `order`, with the number of each row's range."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return settled(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))


def _offsets(rows: DataFrame, key: str) -> DataFrame:
    """__k0, __p0, __before (rows of the key in earlier ranges), __here and __all."""
    counts = rows.groupBy(F.col(key).alias("__k0"), F.col("__part").alias("__p0")).agg(F.count(F.lit(1)).alias("__here"))
    of = W.partitionBy("__k0")
    before = F.coalesce(F.sum("__here").over(of.orderBy("__p0").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.select("*", before.alias("__before"), F.sum("__here").over(of).alias("__all"))


def placed(df: DataFrame, key: str = KEY, time: str = TIME, columns: Sequence[str] | None = None) -> DataFrame:
    """Adds __place, the number of each row in its series from 0 on; `time` must be a total order within a series.

    With `columns`, only these (and the key) are written and kept; a wide `time` need not go further than the sort.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    columns = [*dict.fromkeys([key, *(df.columns if columns is None else columns)])]
    rows = df.select(*dict.fromkeys([*columns, time])).repartitionByRange(parts, key, time).sortWithinPartitions(key, time)
    # The number that increases holds the partition in its upper bits, and the row in the lower 33.
    number, low = F.monotonically_increasing_id(), (1 << 33) - 1
    rows = rows.withColumn("__n", number).withColumns({"__part": F.shiftright("__n", 33).cast("int"), "__at": F.col("__n").bitwiseAND(F.lit(low)).cast("int")}).drop("__n")
    rows = settled(rows.select(*columns, "__part", "__at"))
    counts = rows.groupBy(F.col(key).alias("__k0"), F.col("__part").alias("__p0")).agg(F.count(F.lit(1)).alias("__here"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__here").over(W.partitionBy("__k0").orderBy("__p0").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = small(counts.select("__k0", "__p0", (before - F.col("__first")).alias("__before")))
    found = rows.join(starts, F.col(key).eqNullSafe(F.col("__k0")) & (F.col("__part") == F.col("__p0")))
    return found.withColumn(PLACE, F.col("__at") + F.col("__before")).drop("__part", "__at", "__k0", "__p0", "__before")


def _with_places(df: DataFrame, key: str, time: str) -> DataFrame:
    return df if PLACE in df.columns else placed(df, key, time)


def in_blocks(df: DataFrame, reach: int, steps: Sequence[Callable[[WindowSpec], Mapping[str, Column]]], key: str = KEY, time: str = TIME, size: int = ROWS, keep: bool = False) -> DataFrame:
    """Adds columns over windows that look back `reach` rows at most, all steps together.

    Each step gets the window of a block (partitioned, and ordered in time) and returns columns, which may use those of
    the steps before it.  A block's windows see `reach` rows of the block before, so frames must be bounded by it.  With
    `keep`, the number of the block stays as __b, and `hysteresis` of blocks of the same size doesn't deal the rows again.
    """
    size = max(size, reach)
    rows = _with_places(df, key, time)
    own = F.floor(F.col(PLACE) / size)
    copied = F.when(F.col(PLACE) % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("__b", F.explode(copied))
    w = W.partitionBy(key, "__b").orderBy(PLACE)
    for step in steps:
        rows = rows.withColumns(dict(step(w)))
    rows = rows.filter(own == F.col("__b"))
    rows = rows if keep else rows.drop("__b")
    return rows if PLACE in df.columns else rows.drop(PLACE)


def _joined(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Rows with what is known of their block (__k1, __b1, ...)."""
    return rows.join(small(blocks), F.col(key).eqNullSafe(F.col("__k1")) & (F.col("__b") == F.col("__b1"))).drop("__k1", "__b1")


HOW = {"sum": (F.sum, lambda a, b: a + b), "count": (F.count, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(df: DataFrame, values: Mapping[str, tuple[str, Column]], key: str = KEY, time: str = TIME, size: int = ROWS) -> DataFrame:
    """Adds the sum, count, max or min of all values so far, by name: (how, value)."""
    rows = _with_places(df, key, time).withColumn("__b", F.floor(F.col(PLACE) / size)).withColumns({f"__x_{k}": x for k, (_, x) in values.items()})
    totals = rows.groupBy(F.col(key).alias("__k1"), F.col("__b").alias("__b1")).agg(*(HOW[how][0](f"__x_{k}").alias(f"__t_{k}") for k, (how, _) in values.items()))
    earlier = W.partitionBy("__k1").orderBy("__b1").rowsBetween(W.unboundedPreceding, -1)
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    blocks = totals.select("__k1", "__b1", *(merge[how](f"__t_{k}").over(earlier).alias(f"__c_{k}") for k, (how, _) in values.items()))
    inside = W.partitionBy(key, "__b").orderBy(PLACE).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"__l_{k}": HOW[how][0](f"__x_{k}").over(inside) for k, (how, _) in values.items()})
    both = {k: (F.col(f"__c_{k}"), F.col(f"__l_{k}")) for k in values}
    out = _joined(rows, blocks, key).withColumns({k: F.coalesce(HOW[how][1](*both[k]), both[k][1], both[k][0]) for k, (how, _) in values.items()})
    drop = [f"__{part}_{k}" for k in values for part in "xlc"] + ["__b"] + ([] if PLACE in df.columns else [PLACE])
    return out.drop(*drop)


def recurrences(df: DataFrame, inputs: Mapping[str, tuple[Column, float]], key: str = KEY, time: str = TIME, size: int = ROWS) -> DataFrame:
    """As ewm.recurrences, with decays that are numbers."""
    rows = _with_places(df, key, time).withColumn("__b", F.floor(F.col(PLACE) / size)).withColumn("__kb", F.struct(key, "__b"))
    local = ewm.recurrences(rows, inputs, "__kb", PLACE)
    ends = local.groupBy(F.col(key).alias("of"), F.col("__b").alias("at")).agg(*(F.max_by(name, PLACE).alias(f"__e_{name}") for name in inputs))
    # From block to block the same recurrence holds, as all blocks but the last are of one length.
    ends = ewm.recurrences(ends, {f"__y_{name}": (F.col(f"__e_{name}"), float(d**size)) for name, (_, d) in inputs.items()}, "of", "at")
    before = W.partitionBy("of").orderBy("at")
    blocks = ends.select(F.col("of").alias("__k1"), F.col("at").alias("__b1"), *(F.coalesce(F.lag(f"__y_{name}").over(before), F.lit(0.0)).alias(f"__y_{name}") for name in inputs))
    out = _joined(local, blocks, key).withColumns({name: F.col(name) + F.pow(F.lit(d), F.col(PLACE) % size + 1) * F.col(f"__y_{name}") for name, (_, d) in inputs.items()})
    return out.drop("__b", "__kb", *(f"__y_{name}" for name in inputs), *([] if PLACE in df.columns else [PLACE]))


def ewms(df: DataFrame, means: Mapping[str, ewm.Mean], key: str = KEY, time: str = TIME, size: int = ROWS) -> DataFrame:
    """As ewm.ewms."""
    counts = lambda rows, values, key, time: running(rows, {k: ("count", x) for k, x in values.items()}, key, time, size)
    recur = lambda rows, inputs, key, time: recurrences(rows, inputs, key, time, size)
    out = ewm.ewms(_with_places(df, key, time), means, key, time, counts, recur)
    return out if PLACE in df.columns else out.drop(PLACE)


def hysteresis(df: DataFrame, z: Column, entry: float, leave: float, out: str = "position", sign: int = -1, key: str = KEY, time: str = TIME, size: int = ROWS) -> DataFrame:
    """As state.hysteresis."""
    if leave > entry:
        raise ValueError("leave must not exceed entry")
    rows = df if "__b" in df.columns else _with_places(df, key, time).withColumn("__b", F.floor(F.col(PLACE) / size))
    rows = rows.withColumn("__z", z)
    inside = W.partitionBy(key, "__b").orderBy(PLACE).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__g", F.sum(F.when(F.abs("__z") < leave, 1).otherwise(0)).over(inside))
    side = F.when(F.col("__z") > entry, sign).when(F.col("__z") < -entry, -sign)
    # The position, had the block been entered without one: the first entry since the last exit.
    episode = W.partitionBy(key, "__b", "__g").orderBy(PLACE).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__h", F.coalesce(F.first(side, ignorenulls=True).over(episode), F.lit(0)))
    maps = rows.groupBy(F.col(key).alias("__k1"), F.col("__b").alias("__b1")).agg((F.max("__g") > 0).alias("forgets"), F.max_by("__h", PLACE).alias("left"))
    # Blocks since the last one that forgets, itself included: the first of them that is left with a position decides.
    blocks = W.partitionBy("__k1").orderBy("__b1")
    maps = maps.withColumn("since", F.sum(F.col("forgets").cast("int")).over(blocks.rowsBetween(W.unboundedPreceding, 0)))
    held = F.first(F.when(F.col("left") != 0, F.col("left")), ignorenulls=True).over(W.partitionBy("__k1", "since").orderBy("__b1").rowsBetween(W.unboundedPreceding, 0))
    maps = maps.withColumn("after", F.coalesce(held, F.lit(0)))
    entered = maps.select("__k1", "__b1", F.coalesce(F.lag("after").over(blocks), F.lit(0)).alias("__s"))
    kept = F.when((F.col("__g") == 0) & (F.col("__s") != 0), F.col("__s")).otherwise(F.col("__h"))
    found = _joined(rows, entered, key).withColumn(out, F.when(F.col("__z").isNull(), 0).otherwise(kept))
    return found.drop("__b", "__z", "__g", "__h", "__s", *([] if PLACE in df.columns else [PLACE]))


def drawdown(df: DataFrame, x: Column, out: str = "drawdown", key: str = KEY, time: str = TIME, size: int = ROWS) -> DataFrame:
    """Adds x less its running maximum."""
    return running(df.withColumn("__v", x), {"__top": ("max", F.col("__v"))}, key, time, size).withColumn(out, F.col("__v") - F.col("__top")).drop("__v", "__top")


def longest_run(df: DataFrame, flag: Column, key: str = KEY, time: str = TIME, size: int = ROWS) -> DataFrame:
    """As state.longest_run: rows of a run share the number of rows without the flag so far, whatever blocks they lie in."""
    rows = df.withColumn("__f", F.coalesce(flag, F.lit(False)))
    rows = running(rows, {"__g": ("sum", F.when(F.col("__f"), 0).otherwise(1))}, key, time, size)
    runs = rows.groupBy(key, "__g").agg(F.sum(F.col("__f").cast("long")).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"))


def quantiles(df: DataFrame, x: str, shares: Sequence[float], key: str = KEY) -> DataFrame:
    """key and quantiles q0, q1, ... of x, linear between the two values around each, as percentile() gives them.

    The ranges in which rows are laid out by (key, x) are buckets; their counts say in which of them a quantile lies, and
    only those are sorted.
    """
    rows = laid(df.select(key, x).filter(F.col(x).isNotNull()), key, x)
    at = F.col("share") * (F.col("__all") - 1)
    wanted = _offsets(rows, key).withColumn("which", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)))))
    wanted = wanted.select("__k0", "__p0", "__before", "__here", "__all", "which.*")
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))).filter("rank >= __before and rank < __before + __here")
    wanted = wanted.select("__k0", "__p0", "k", (F.col("rank") - F.col("__before")).alias("r0"), (F.col("rank") - at).alias("off"))
    some = rows.join(wanted.select("__k0", "__p0").distinct(), F.col(key).eqNullSafe(F.col("__k0")) & (F.col("__part") == F.col("__p0")), "left_semi")
    ranked = some.select(F.col(key).alias("k1"), F.col("__part").alias("p1"), F.col(x).cast("double").alias("v"), (F.row_number().over(W.partitionBy(key, "__part").orderBy(x)) - 1).alias("r1"))
    met = ranked.join(wanted, F.col("k1").eqNullSafe(F.col("__k0")) & (F.col("p1") == F.col("__p0")) & (F.col("r1") == F.col("r0")))
    # The value below weighs what is missing to the one above, and the other way round.
    value = F.sum(F.col("v") * (1 - F.abs("off")))
    wide = met.groupBy(F.col("k1").alias(key)).pivot("k", list(range(len(shares)))).agg(value)
    return wide.select(key, *(F.col(str(k)).alias(f"q{k}") for k in range(len(shares))))
