"""News events: signed impulses, double-exponential decay, crisis flags, dedupe in arrival order."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import hot
from tidemark.operators.ewm import recurrences

# Base impulse of a severity tier, and (half-life fast, half-life slow in days, fast weight, largest
# impulse) of an event class; the last class is the default.
TIERS = {1: 0.25, 2: 0.75, 3: 1.5, 4: 2.5, 5: 3.0}
CLASSES = {"purchase": (1.0, 5.0, 0.6, 3.0), "signup": (0.5, 3.0, 0.7, 2.0), "error": (2.0, 10.0, 0.5, 3.0), "noise": (0.25, 1.0, 0.8, 0.5)}
SIGNS = {"hawkish": 1, "dovish": -1}


def impulse() -> Column:
    """tier base x confidence x sign, clipped to the class's cap, to four places."""
    base = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.col("tier")), F.lit(0.25))
    sign = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SIGNS.items() for x in kv)), F.col("direction")), F.lit(0))
    cap = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in CLASSES.items() for x in (k, v[3]))), F.col("event_class")), F.lit(CLASSES["noise"][3]))
    raw = base * F.col("confidence") * sign
    return F.floor(F.greatest(-cap, F.least(cap, raw)) * 1e4 + 0.5) / 1e4


def decayed_score(days: DataFrame, events: DataFrame, crisis: float = 2.0, remaining: float = 0.2) -> DataFrame:
    """dt, score and is_crisis: every event's impulse, decayed by its class, at the begin of each later day.

    A day adds the impulses of the day before, decayed to its end, to what it inherits; so days and classes are joined by
    equality and each sum is one recurrence over a class's days, not a join of days with events.  A day is a crisis if
    the score is beyond `crisis`, or while an override's slow part has more than `remaining` of its size.
    """
    table = [(k, math.log(2) / v[0], math.log(2) / v[1], v[2]) for k, v in CLASSES.items()]
    dims = events.sparkSession.createDataFrame(table, "class string, lf double, ls double, wf double")
    known = F.when(F.col("event_class").isin(*CLASSES), F.col("event_class")).otherwise("noise")
    e = events.withColumn("imp", impulse()).filter("imp <> 0").withColumn("class", known).join(F.broadcast(dims), "class")
    left = (F.unix_micros(F.date_add(F.to_date("ts"), 1).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6
    daily = e.groupBy("class", F.date_add(F.to_date("ts"), 1).alias("dt")).agg(
        F.sum(F.col("wf") * F.col("imp") * F.exp(-F.col("lf") * left)).alias("f"), F.sum((1 - F.col("wf")) * F.col("imp") * F.exp(-F.col("ls") * left)).alias("s"),
        F.max(F.when(F.col("is_override"), F.col("ts"))).alias("forced"),
    )
    grid = days.select("dt", F.explode(F.array(*(F.lit(k) for k in CLASSES))).alias("class")).join(F.broadcast(dims), "class")
    rows = grid.join(daily, ["class", "dt"], "left")
    zero = F.lit(0.0)
    summed = recurrences(rows, {"fast": (F.coalesce("f", zero), F.exp(-F.col("lf"))), "slow": (F.coalesce("s", zero), F.exp(-F.col("ls")))}, "class", "dt")
    # Of a class's overrides the latest one has most of its size left.
    latest = F.max("forced").over(W.partitionBy("class").orderBy("dt").rowsBetween(W.unboundedPreceding, 0))
    age = (F.unix_micros(F.col("dt").cast("timestamp")) - F.unix_micros(latest.cast("timestamp"))) / 86400e6
    scored = summed.withColumn("forced", F.coalesce(F.exp(-F.col("ls") * age) > remaining, F.lit(False)))
    return scored.groupBy("dt").agg(F.sum(F.col("fast") + F.col("slow")).alias("score"), F.max("forced").alias("forced")).select("dt", "score", ((F.abs("score") > crisis) | F.col("forced")).alias("is_crisis"))


def dedupe(events: DataFrame, key: Column, order: str, ts: str, hours: float = 6) -> DataFrame:
    """Of each key's events in arrival order, those at least `hours` after the last one kept; equal orders by time, then by the other columns.

    What is kept is later than all that came before it, so only such events count, and among them the arrival order is
    that of time.  They are laid out in ranges of (key, time); each range works out what it keeps from the time last kept
    before it, and hands on the last that it keeps itself.  At first each range takes it that nothing was kept before; as
    long as what is handed on differs from what was taken, the ranges concerned are worked out again.  A range mostly
    hands on the same whatever it takes, so two or three passes are the rule; ranges are right from the first one on, so
    it ends.  No task holds a key.  Events without a time are never kept.
    """
    gap = int(hours * 3600e6)
    names = events.columns
    rows = events.withColumn("__k", key).withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp"))).filter("__t is not null")
    rows = rows.withColumn("__o", F.struct(order, "__t", *(c for c in names if c not in (order, ts))))
    so_far = hot.running(hot.placed(rows, "__k", "__o"), {"__top": ("max", F.col("__t"))}, "__k", "__o").withColumnRenamed("__place", "__p")
    # Of equal times at the top so far the first to arrive is the one that reached it.
    first = so_far.filter(F.col("__t") == F.col("__top")).groupBy("__k", "__t").agg(F.min("__p").alias("__p"))
    times = hot.laid(first, "__k", "__t")
    kept = hot.settled(_chain(times, gap)).select(F.col("__k").alias("__k2"), F.col("__p").alias("__p2"))
    return so_far.join(kept, F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__p") == F.col("__p2")), "left_semi").select(*names)


def _hops(times: np.ndarray, last: int | None, gap: int) -> list[int]:
    """Places in sorted times of those kept, if `last` was kept before."""
    at = 0 if last is None else int(np.searchsorted(times, last + gap))
    out = []
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + gap))
    return out


def _chain(times: DataFrame, gap: int) -> DataFrame:
    """__k and __p of the times kept, from (__k, __t, __p, __part)."""
    of = W.partitionBy("__k").orderBy("__part")
    kind = times.schema["__k"].dataType.simpleString()

    def worked(taken: DataFrame, every: bool) -> DataFrame:
        """What ranges hand on, or all that they keep, from what they take."""

        def work(table: pa.Table) -> pa.Table:
            table = table.sort_by("__t")
            t, last = table.column("__t").to_numpy(), table.column("__last")[0].as_py()
            found = _hops(t, last, gap)
            if every:
                return table.select(["__k", "__p"]).take(pa.array(found, pa.int64()))
            return table.select(["__k", "__part"]).slice(0, 1).append_column("__next", pa.array([int(t[found[-1]]) if found else last], pa.int64()))

        given = taken.select(F.col("__k").alias("__k3"), F.col("__part").alias("__part3"), "__last")
        met = times.join(given, F.col("__k").eqNullSafe(F.col("__k3")) & (F.col("__part") == F.col("__part3")))
        out = f"__k {kind}, __p long" if every else f"__k {kind}, __part int, __next long"
        return met.select("__k", "__part", "__t", "__p", "__last").groupBy("__k", "__part").applyInArrow(work, out)

    state = hot.settled(times.select("__k", "__part").distinct().withColumn("__last", F.lit(None).cast("long")))
    state = hot.settled(worked(state, False).withColumn("__last", F.lit(None).cast("long")))
    while True:
        told = state.withColumn("__told", F.lag("__next").over(of))
        differ = ~F.col("__told").eqNullSafe(F.col("__last"))
        again = hot.settled(told.filter(differ).select("__k", "__part", F.col("__told").alias("__last")))
        if again.isEmpty():
            return worked(state, True)
        renewed = worked(again, False).select(F.col("__k").alias("__k4"), F.col("__part").alias("__part4"), F.col("__next").alias("__next4"))
        both = told.join(renewed, F.col("__k").eqNullSafe(F.col("__k4")) & (F.col("__part") == F.col("__part4")), "left")
        state = hot.settled(both.select("__k", "__part", F.when(differ, F.col("__next4")).otherwise(F.col("__next")).alias("__next"), F.when(differ, F.col("__told")).otherwise(F.col("__last")).alias("__last")))


FIELDS = "event_class string, direction string, severity_tier int, confidence double, reasoning string"


def classified(df: DataFrame, answer: str, overriding: Sequence[str] = (), least: float = 0.4) -> DataFrame:
    """Adds event_class, direction, tier, confidence and is_override from answers in JSON; what is less sure than `least` goes.

    Confidences are clamped to 0 and 1.  An answer that can't be read or lacks a field is noise without confidence.
    """
    j = F.from_json(answer, FIELDS)
    whole = F.col("__j").isNotNull()
    for field in FIELDS.split(", "):
        whole = whole & F.col(f"__j.{field.split()[0]}").isNotNull()
    df = df.withColumn("__j", j).withColumn("__ok", F.coalesce(whole, F.lit(False)))
    take = lambda field, missing: F.when(F.col("__ok"), F.col(f"__j.{field}")).otherwise(missing)
    df = df.withColumns({
        "event_class": take("event_class", "noise"), "direction": take("direction", "neutral"), "tier": take("severity_tier", 1),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), take("confidence", 0.0))),
    }).filter(F.col("confidence") >= least)
    return df.withColumn("is_override", F.col("event_class").isin(*overriding) & (F.col("tier") >= 4)).drop("__j", "__ok")
