"""Operators that serve batch and Structured Streaming alike."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import hot
from tidemark.operators.events import CLASSES
from tidemark.operators.tags import currencies


def timed(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need instants: local times count as those of the session's zone."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def ohlc_bars(ticks: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bars of ticks (series_id, ts, price, event_id); a stream gets a watermark and emits bars once they are closed."""
    rows = timed(ticks).withWatermark("ts", late) if ticks.isStreaming else ticks
    at = F.struct("ts", "event_id")
    bars = rows.groupBy("series_id", F.window("ts", width)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("n")
    )
    return bars.select("series_id", F.col("window.start").alias("bucket"), "open", "high", "low", "close", "n")


def once_per_key(events: DataFrame, key: str, ts: str = "ts", within: str = "6 hours") -> DataFrame:
    """The first event of each key within a watermark; unlike the batch dedupe, the clock is event time."""
    return timed(events, ts).withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def kept_apart(events: DataFrame, key: str, order: str, ts: str = "ts", hours: float = 6, late: str = "1 day") -> DataFrame:
    """Of a stream, each key's events at least `hours` after the last one kept, in arrival order: events.dedupe, batch by batch.

    The state of a key is the time last kept.  Once the watermark (`late` behind the latest event) is past the time at
    which any event would be kept anyway, a timer drops it, so keys that have gone quiet cost nothing.  A micro-batch is
    taken in the order of `order`, then time; events without a time are never kept.
    """
    gap = int(hours * 3600e6)
    rows = timed(events, ts).filter(F.col(ts).isNotNull()).withWatermark(ts, late)
    kinds = dict(rows.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        part = pd.concat(list(parts)).sort_values([order, ts], kind="stable")
        t = _micros(part[ts])
        last = state.get[0] if state.exists else None
        # Only what is later than all before it in the batch can be kept.
        top = np.maximum.accumulate(t)
        first = np.flatnonzero(np.concatenate([[True], top[1:] > top[:-1]]))
        at, found = 0 if last is None else int(np.searchsorted(t[first], last + gap)), []
        while at < len(first):
            found.append(first[at])
            last = int(t[first[at]])
            at = int(np.searchsorted(t[first], last + gap))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield part.iloc[found][list(kinds)]

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return rows.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def filing_log(commands: DataFrame, day: str = "day", order: str = "ord") -> DataFrame:
    """Numbered filings of a stream of (day, ord, raw, kind, flag), each day in the order of `ord` within a micro-batch.

    kind `file` files raw, late if its day is closed; flag forces it in then.  kind `close` closes the day, and flag says
    whether late filings are allowed.  Blank filings, and late ones that are neither allowed nor forced, are rejected.
    The state of a day is how many it has, and whether and how it was closed; numbers have no gaps over micro-batches.
    """
    kinds = dict(commands.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, closed, allowed = state.get if state.exists else (0, False, False)
        part = pd.concat(list(parts)).sort_values(order, kind="stable")
        close, flag = (part["kind"] == "close").to_numpy(), part["flag"].fillna(False).to_numpy(bool)
        # For each row the last close before it, in this batch or in the state.
        at = np.maximum.accumulate(np.where(close, np.arange(len(part)), -1))
        late = closed | (at >= 0)
        may = np.where(at >= 0, flag[np.maximum(at, 0)], allowed)
        text = part["raw"].fillna("").str.strip(" ")
        taken = ~close & (text != "").to_numpy() & (~late | may | flag)
        seq = count + np.cumsum(taken)
        state.update((int(seq[-1]), bool(late[-1]), bool(may[-1])))
        out = part[taken]
        yield pd.DataFrame({day: out[day], order: out[order], "raw": out["raw"], "seq": seq[taken], "status": np.where(late[taken], "closed", "open"), "late": late[taken]})

    schema = f"{day} {kinds[day]}, {order} {kinds[order]}, raw string, seq long, status string, late boolean"
    filed_ = commands.groupBy(day).applyInPandasWithState(step, schema, "count long, closed boolean, allowed boolean", "append", GroupStateTimeout.NoTimeout)
    return filed_.withColumn("tags", currencies(F.col("raw")))


def held_positions(z: np.ndarray, held: int, entry: float, leave: float, sign: int) -> tuple[np.ndarray, int]:
    """Positions of rows in order, from the position held before them, and the one after them; NaN gives 0 and keeps it."""
    rows = np.arange(len(z))
    with np.errstate(invalid="ignore"):
        out = np.maximum.accumulate(np.where(np.abs(z) < leave, rows, -1)) if len(z) else rows
        enter = np.flatnonzero(np.abs(z) > entry)
    # The first entry since the last exit decides, if it is not behind the row.
    first = np.append(enter, len(z))[np.searchsorted(enter, np.maximum(out, 0))] if len(z) else rows
    side = np.append(np.where(z > 0, sign, -sign), 0)
    now = np.where((out < 0) & (held != 0), held, np.where(first <= rows, side[first], 0))
    return np.where(np.isnan(z), 0, now).astype(int), int(now[-1]) if len(z) else held


def positions(rows: DataFrame, entry: float, leave: float, sign: int = -1) -> DataFrame:
    """series_id, dt, z and position of a stream of (series_id, dt, z), each series in the order of dt within a batch.

    The state of a series is one number, whatever its length; the rule is that of operators.state.hysteresis.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts)).sort_values("dt")
        got, held = held_positions(part["z"].to_numpy(float), state.get[0] if state.exists else 0, entry, leave, sign)
        state.update((held,))
        yield pd.DataFrame({"series_id": key[0], "dt": part["dt"], "z": part["z"], "position": got})

    kinds = dict(rows.dtypes)
    schema = f"series_id {kinds['series_id']}, dt {kinds['dt']}, z double, position int"
    return rows.groupBy("series_id").applyInPandasWithState(step, schema, "held int", "append", GroupStateTimeout.NoTimeout)


def filed(submissions: DataFrame, closed: DataFrame) -> DataFrame:
    """Submissions (day, ts, raw) that are not blank, with their currency tags; late where their day is in the table `closed`."""
    rows = submissions.filter(F.trim("raw") != "").withColumn("tags", currencies(F.col("raw")))
    marks = closed.select("day").distinct().withColumn("late", F.lit(True))
    return rows.join(marks, "day", "left").withColumn("late", F.coalesce("late", F.lit(False)))


def decayed_sums(at: np.ndarray, x: np.ndarray, last: float, since: float, rate: float, reach: float = 300.0) -> np.ndarray:
    """Of sorted times, the sum of all x so far, each decayed by `rate` since its time, and of `last`, decayed since `since`.

    A stretch over which the decay is e ** -reach at most is one cumulative sum of x grown back to its begin.
    """
    out = np.empty(len(at))
    i = 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + reach / rate, "right"))
        grown = np.exp(rate * (at[i:j] - at[i]))
        out[i:j] = (last * math.exp(-rate * (at[i] - since)) + np.cumsum(x[i:j] * grown)) / grown
        last, since, i = float(out[j - 1]), float(at[j - 1]), j
    return out


def decayed_totals(events: DataFrame) -> DataFrame:
    """event_class, ts and score after each event of a stream of (event_class, ts, imp), each class in the order of ts.

    The state of a class is its fast and slow sums and the time they stand for: an event decays both to its own time and
    adds its weighted impulse, so nothing of the past is kept.  Events of a later batch that are older than the state
    are added as if they came at its time.  A class's part of a micro-batch is one task's; see totals_of_batches for large ones.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fast, slow, weight, _ = CLASSES.get(key[0], CLASSES["noise"])
        f, s, at = state.get if state.exists else (0.0, 0.0, None)
        part = pd.concat(list(parts)).dropna(subset=["ts"]).sort_values("ts")
        if not len(part):
            return
        days = part["ts"].to_numpy("datetime64[ns]").astype(np.int64) / 86400e9
        days = np.maximum(days, days[0] if at is None else at)
        imp = part["imp"].fillna(0.0).to_numpy(float)
        sums = [decayed_sums(days, imp * w, last, days[0] if at is None else at, math.log(2) / half) for w, last, half in ((weight, f, fast), (1 - weight, s, slow))]
        state.update((float(sums[0][-1]), float(sums[1][-1]), float(days[-1])))
        yield pd.DataFrame({"event_class": key[0], "ts": part["ts"], "score": sums[0] + sums[1]})

    return events.groupBy("event_class").applyInPandasWithState(step, "event_class string, ts timestamp, score double", "f double, s double, at double", "append", GroupStateTimeout.NoTimeout)


def _of_class(value: Callable[[tuple], float]) -> Column:
    """A number of each event's class, or of noise."""
    out = F.lit(float(value(CLASSES["noise"])))
    for name, of in CLASSES.items():
        out = F.when(F.col("event_class") == name, float(value(of))).otherwise(out)
    return out


def _carried(part: pd.DataFrame) -> pd.DataFrame:
    """What each block of a class is entered with (f0, s0 as of at0) and left with (f, s as of at), from the state and the blocks' own sums."""
    part = part.sort_values("__part")
    ends, at = part["end"].to_numpy(float), part["at"].iloc[0]
    since = part["start"].iloc[0] if pd.isna(at) else at
    out = {"event_class": part["event_class"], "__part": part["__part"], "at0": np.concatenate([[since], ends[:-1]]), "at": ends}
    for k in "fs":
        last = 0.0 if pd.isna(at) else part[k].iloc[0]
        out[k] = decayed_sums(ends, part[f"sum_{k}"].to_numpy(float), last, since, part[f"rate_{k}"].iloc[0])
        out[f"{k}0"] = np.concatenate([[last], out[k][:-1]])
    return pd.DataFrame(out)


def _scores(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scores of rows sorted by class, block and time, chunk after chunk; only the last sums are held."""
    key, held = None, {}
    for part in parts:
        of, block, days = part["event_class"].to_numpy(object), part["__part"].to_numpy(), part["days"].to_numpy(float)
        score = np.zeros(len(part))
        new = np.flatnonzero((of[1:] != of[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(part)], strict=True):
            if a == b:
                continue
            if key != (of[a], block[a]):
                key, held = (of[a], block[a]), {k: (part[f"{k}0"].iloc[a], part["at0"].iloc[a]) for k in "fs"}
            for k in "fs":
                sums = decayed_sums(days[a:b], part[f"x_{k}"].to_numpy(float)[a:b], *held[k], part[f"rate_{k}"].iloc[a])
                held[k] = sums[-1], days[b - 1]
                score[a:b] += sums
        yield pd.DataFrame({"event_class": part["event_class"], "ts": part["ts"], "score": score})


def totals_of_batches(path: str) -> Callable[[DataFrame, int], None]:
    """decayed_totals for micro-batches of any size, with foreachBatch: scores in `path`/totals, the state of all classes in `path`/sums.

    A batch is laid out in ranges of (class, time).  A range's sums, decayed to its end, give what the next one is entered
    with, so no task holds a class: rows pass in chunks.  A batch that is run again overwrites what it has written.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        kind = "event_class string, f double, s double, at double"
        state = spark.read.schema(kind).parquet(f"{path}/sums/n={n - 1}") if n else spark.createDataFrame([], kind)
        state = F.broadcast(state.withColumnRenamed("event_class", "of"))
        rows = timed(batch).filter(F.col("ts").isNotNull()).select("event_class", "ts", F.coalesce("imp", F.lit(0.0)).alias("imp"))
        rows = hot.laid(rows, "event_class", "ts", "imp").join(state, F.col("event_class").eqNullSafe(F.col("of")), "left").drop("of")
        weight = _of_class(lambda c: c[2])
        rows = rows.withColumns({"days": F.greatest(F.unix_micros("ts") / 86400e6, "at"), "x_f": F.col("imp") * weight, "x_s": F.col("imp") * (1 - weight)})
        rows = rows.withColumns({"rate_f": _of_class(lambda c: math.log(2) / c[0]), "rate_s": _of_class(lambda c: math.log(2) / c[1])})
        ends = rows.groupBy(F.col("event_class").alias("c1"), F.col("__part").alias("p1")).agg(F.max("days").alias("end"), F.min("days").alias("start"))
        sums = rows.join(hot.small(ends), F.col("event_class").eqNullSafe(F.col("c1")) & (F.col("__part") == F.col("p1"))).groupBy("event_class", "__part").agg(
            *(F.first(c).alias(c) for c in ("end", "start", "f", "s", "at", "rate_f", "rate_s")),
            *(F.sum(F.col(f"x_{k}") * F.exp(-F.col(f"rate_{k}") * (F.col("end") - F.col("days")))).alias(f"sum_{k}") for k in "fs"),
        )
        carried = hot.settled(sums.groupBy("event_class").applyInPandas(_carried, "event_class string, __part int, at0 double, f0 double, s0 double, at double, f double, s double"))
        into = hot.small(carried.select(F.col("event_class").alias("c1"), F.col("__part").alias("p1"), "at0", "f0", "s0"))
        rows = rows.drop("f", "s", "at").join(into, F.col("event_class").eqNullSafe(F.col("c1")) & (F.col("__part") == F.col("p1")))
        rows = rows.select("event_class", "__part", "ts", "days", "x_f", "x_s", "rate_f", "rate_s", "at0", "f0", "s0").repartition("event_class", "__part").sortWithinPartitions("event_class", "__part", "ts", "x_f")
        rows.mapInPandas(_scores, "event_class string, ts timestamp, score double").write.mode("overwrite").parquet(f"{path}/totals/n={n}")
        last = carried.groupBy("event_class").agg(*(F.max_by(c, "__part").alias(c) for c in ("f", "s", "at")))
        gone = state.join(last, F.col("of").eqNullSafe(F.col("event_class")), "left_anti").select(F.col("of").alias("event_class"), "f", "s", "at")
        last.unionByName(gone).coalesce(1).write.mode("overwrite").parquet(f"{path}/sums/n={n}")

    return step
