"""The switching model of regimes.switching_probs for series of any length: filter and smoother as scans over blocks of rows.

A row takes the filter from one vector of state probabilities to the next by a small matrix: the transitions, times the
likelihoods of its value in each state.  The product of a block's matrices says what the block does to whatever enters it,
so blocks are multiplied in parallel, the products of a series' blocks are composed (a table of a row per series and
`ROWS` rows), and then each block filters and smooths its own rows from what enters it at both ends.  Inside a block, rows
are cut into lanes that go through their rows together, in the same two steps.  What the next fit needs are sums over rows,
which Spark adds up.  Starts, rules of failure and of convergence are those of `regimes.switching_fit`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import hot
from tidemark.operators.regimes import NAMES, WIDTHS

#: Rows of a block, and of a lane of it.
ROWS, LANE = 1 << 16, 256
KINDS = {"double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _likelihoods(y: np.ndarray, z: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likelihoods of rows by state, the largest of a row being one, and the logarithms that they were divided by."""
    level, lag, dev = p
    log = -0.5 * ((y[:, None] - level - lag * z[:, None]) / dev) ** 2 - np.log(dev)
    top = log.max(axis=1)
    return np.exp(log - top[:, None]), top


def _lanes(like: np.ndarray) -> np.ndarray:
    """Likelihoods as [lane, row, state]; rows that fill up the last lane are marked by -1."""
    n, k = like.shape
    lanes = -(-n // LANE)
    out = np.full((lanes * LANE, k), -1.0)
    out[:n] = like
    return out.reshape(lanes, LANE, k)


def _products(lanes: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Of each lane, the product of its rows' matrices, up to a factor."""
    k = lanes.shape[2]
    out = np.repeat(np.eye(k)[None], len(lanes), axis=0)
    for r in range(LANE):
        like = lanes[:, r]
        there = like[:, 0] >= 0
        step = (out[there] @ move) * like[there][:, None, :]
        out[there] = step / step.sum(axis=(1, 2), keepdims=True)
    return out


def _filtered(lanes: np.ndarray, move: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered probabilities and their divisors of all rows, from the vectors that enter each lane."""
    ahead, size = np.zeros(lanes.shape), np.ones(lanes.shape[:2])
    now = enter
    for r in range(LANE):
        like = np.maximum(lanes[:, r], 0)
        there = lanes[:, r, 0] >= 0
        new = (now @ move) * like
        size[there, r] = new[there].sum(axis=1)
        now = np.where(there[:, None], new / size[:, r, None], now)
        ahead[:, r] = now
    return ahead, size


def _smoothed(lanes: np.ndarray, move: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all rows, up to a factor, how likely all later rows are by state, and the same one row on with its likelihood."""
    back, ahead = np.ones(lanes.shape), np.zeros(lanes.shape)
    now = leave
    for r in range(LANE - 1, -1, -1):
        there = lanes[:, r, 0] >= 0
        back[:, r] = now
        seen = np.maximum(lanes[:, r], 0) * now
        ahead[:, r] = seen
        new = seen @ move.T
        now = np.where(there[:, None], new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300), now)
    return back, ahead


def _enter(products: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """What enters each of a chain of products, if `begin` enters the first."""
    out = np.empty((len(products), len(begin)))
    now = begin
    for i, m in enumerate(products):
        out[i] = now
        now = now @ m
        now = now / now.sum()
    return out


def _leave(products: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What the rows behind each of a chain of products make likely, if `end` stands behind the last."""
    out = np.empty((len(products), len(end)))
    now = end
    for i in range(len(products) - 1, -1, -1):
        out[i] = now
        now = products[i] @ now
        now = now / now.sum()
    return out


class _Block:
    """A block's rows in order, under parameters (level, lag, deviation, move, begin) and what else is known of it, in one row."""

    def __init__(self, table: pa.Table, known: pa.Table, states: int):
        self.table = table.sort_by("__place")
        column = lambda c: self.table.column(c).to_numpy()
        self.y, self.z = column("y").astype(float), column("z").astype(float)
        self.known = {c: known.column(c)[0].as_py() for c in known.column_names}
        p, k = np.array(self.known["par"], float), states
        self.p, self.move, self.begin = p[: 3 * k].reshape(3, k), p[3 * k : 3 * k + k * k].reshape(k, k), p[3 * k + k * k :]
        like, self.top = _likelihoods(self.y, self.z, self.p)
        self.first = int(column("__place")[0]) == 0
        if self.first:
            # The first row has no row before it: its matrix ignores what enters.
            self.one = self.begin * like[0]
        self.like = like

    def matrices(self) -> tuple[np.ndarray, np.ndarray | None]:
        """Lanes of all rows but a series' first, and the vector that enters them after it."""
        if not self.first:
            return _lanes(self.like), None
        return _lanes(self.like[1:]) if len(self.like) > 1 else np.zeros((0, LANE, self.like.shape[1])), self.one / self.one.sum()


def _composed(products: np.ndarray, k: int) -> np.ndarray:
    out = np.eye(k)
    for m in products:
        out = out @ m
        out = out / out.sum()
    return out


def switching_probs(df: DataFrame, x: str, states: int = 3, rounds: int = 50, tolerance: float = 1e-6, fewest: float = 5.0, size: int = ROWS) -> DataFrame:
    """As regimes.switching_probs, but for series of under 11 rows or without spread: those have equal probabilities."""
    k = states
    rows = hot.placed(df.filter(F.col(x).isNotNull()).select("series_id", "dt", F.col(x).cast("double").alias("x")))
    # The row before comes over the border of blocks.
    rows = hot.in_blocks(rows, 1, [lambda w: {"z": F.lag("x").over(w)}], size=size)
    rows = rows.filter("z is not null").select("series_id", "dt", F.col("x").alias("y"), "z", (F.col("__place") - 1).alias("__place"), F.floor((F.col("__place") - 1) / size).alias("block"))
    rows = hot.settled(rows)
    kind = dict(rows.dtypes)
    about = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.stddev_pop("y").alias("spread"))
    about = hot.settled(about)
    fit_for = about.filter((F.col("n") >= 9) & (F.col("spread") > 1e-12))

    def start(w: float, kk: int) -> DataFrame:
        scale = w ** np.linspace(-0.5, 0.5, kk)
        move = np.full((kk, kk), 0.1 / max(1, kk - 1))
        np.fill_diagonal(move, 0.9)
        par = [F.col("my")] * kk + [F.lit(0.0)] * kk + [F.col("spread") * float(s) for s in scale] + [F.lit(float(v)) for v in move.ravel()] + [F.lit(1 / kk)] * kk
        return fit_for.select("series_id", F.array(*par).alias("par"), F.lit(float("-inf")).alias("before"))

    blocks = hot.settled(rows.select("series_id", "block").distinct())

    def known(params: DataFrame, ends: DataFrame | None = None) -> DataFrame:
        """A row for each block of the series that have parameters."""
        out = blocks.join(params.select(F.col("series_id").alias("s0"), "par"), F.col("series_id").eqNullSafe(F.col("s0"))).drop("s0")
        if ends is not None:
            out = out.join(ends, F.col("series_id").eqNullSafe(F.col("s1")) & (F.col("block") == F.col("b1"))).drop("s1", "b1")
            out = out.join(about.select(F.col("series_id").alias("s2"), "my", "mz"), F.col("series_id").eqNullSafe(F.col("s2"))).drop("s2")
        return out

    def by_block(work: Callable[[_Block], dict], kk: int, given: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
        """What work makes of each block that is known, by column; `keep`: columns of its rows that go along."""

        def run(table: pa.Table, one: pa.Table) -> pa.Table:
            made, block = {c: [] for c in columns}, table.slice(0, 0)
            if one.num_rows:
                b = _Block(table, one, kk)
                made = work(b)
                block = b.table.slice(0, len(next(iter(made.values()))))
            out = block.select(keep)
            for c, v in made.items():
                out = out.append_column(c, pa.array(v, KINDS[columns[c]]))
            return out

        schema = ", ".join([*(f"{c} {kind[c]}" for c in keep), *(f"{c} {t}" for c, t in columns.items())])
        return rows.groupBy("series_id", "block").cogroup(given.groupBy("series_id", "block")).applyInArrow(run, schema)

    def entered(params: DataFrame, kk: int) -> DataFrame:
        """Of each block: what enters it, and what the blocks behind it make likely."""

        def product(b: _Block) -> dict:
            lanes, one = b.matrices()
            with np.errstate(all="ignore"):
                m = _composed(_products(lanes, b.move), kk)
            return {"m": [(m if one is None else np.tile(one @ m, (kk, 1))).ravel().tolist()]}

        def chain(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("block")
            m = np.stack([np.reshape(v, (kk, kk)) for v in part["m"]])
            with np.errstate(all="ignore"):
                ins, outs = _enter(m, np.full(kk, 1 / kk)), _leave(m, np.full(kk, 1.0))
            return pd.DataFrame({"s1": part["series_id"], "b1": part["block"], "ins": ins.tolist(), "outs": outs.tolist()})

        m = by_block(product, kk, known(params), {"m": "array<double>"}, ["series_id", "block"])
        return hot.settled(m.groupBy("series_id").applyInPandas(chain, f"s1 {kind['series_id']}, b1 long, ins array<double>, outs array<double>"))

    def worked(params: DataFrame, ends: DataFrame, kk: int, out: str):
        """Sums over the rows of each block, or their probabilities."""

        def work(b: _Block) -> dict:
            lanes, one = b.matrices()
            ins, outs = (np.array(b.known[c], float) for c in ("ins", "outs"))
            n = len(b.like)
            with np.errstate(all="ignore"):
                products = _products(lanes, b.move)
                ahead, divisor = _filtered(lanes, b.move, _enter(products, ins if one is None else one))
                back, seen = _smoothed(lanes, b.move, _leave(products, outs))
                flat = lambda a: a.reshape(-1, *a.shape[2:])[: n - (one is not None)]
                f, s, d, g = flat(ahead), flat(back), flat(divisor), flat(seen)
                before = np.concatenate([(ins if one is None else one)[None], f[:-1]]) if len(f) else f
                if one is not None:
                    behind = (g[0] @ b.move.T)[None] if len(g) else outs[None]
                    f, s, d = np.concatenate([one[None], f]), np.concatenate([behind, s]), np.concatenate([[b.one.sum()], d])
                both = f * s
                both /= both.sum(axis=1, keepdims=True)
                joint = before[:, :, None] * b.move * g[:, None, :]
                joint = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                dy, dz = b.y - b.known["my"], b.z - b.known["mz"]
                sums = np.concatenate([both.sum(0), dz @ both, dy @ both, (dz * dz) @ both, (dz * dy) @ both, (dy * dy) @ both, joint.ravel(), both[0] if b.first else np.zeros(kk), [(np.log(d) + b.top).sum()]])
            if out == "sums":
                return {"sums": [sums.tolist()]}
            order = np.argsort(b.p[2], kind="stable")
            return {f"{c}_{name}": p[:, order[i]] if i < kk else np.zeros(n) for c, p in (("p", both), ("f", f)) for i, name in enumerate(NAMES[:states])}

        given = known(params, ends)
        if out == "sums":
            return by_block(work, kk, given, {"sums": "array<double>"}, ["series_id"])
        return by_block(work, kk, given, {f"{c}_{name}": "double" for c in "pf" for name in NAMES[:states]}, ["series_id", "dt"])

    def maximised(params: DataFrame, sums: DataFrame, kk: int) -> DataFrame:
        """series_id, par (the next), used (those of this round), before, done and good."""
        count = 6 * kk + kk * kk + kk + 1
        total = sums.groupBy("series_id").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(count))).alias("t"))
        given = total.join(params.withColumnRenamed("series_id", "s3"), F.col("series_id").eqNullSafe(F.col("s3"))).drop("s3")
        given = given.join(about.withColumnRenamed("series_id", "s4"), F.col("series_id").eqNullSafe(F.col("s4"))).drop("s4")

        def step(batches):
            for part in batches:
                out = []
                for r in part.itertuples(index=False):
                    t = np.array(r.t, float)
                    mass, sz, sy, zz, zy, yy = t[: 6 * kk].reshape(6, kk)
                    pairs, begin, like = t[6 * kk : 6 * kk + kk * kk].reshape(kk, kk), t[-1 - kk : -1], t[-1]
                    with np.errstate(all="ignore"):
                        move = pairs / pairs.sum(axis=1, keepdims=True)
                        az, ay = sz / mass, sy / mass
                        vz, vzy, vy = zz - mass * az * az, zy - mass * az * ay, yy - mass * ay * ay
                        lag = np.clip(np.where(vz > 0, vzy / np.where(vz > 0, vz, 1), 0), -0.99, 0.99)
                        level = (ay + r.my) - lag * (az + r.mz)
                        dev = np.maximum(np.sqrt(np.maximum(vy - 2 * lag * vzy + lag * lag * vz, 0) / mass), r.spread * 1e-3)
                        par = np.concatenate([level, lag, dev, move.ravel(), begin])
                        good = bool(np.isfinite(par).all() and np.isfinite(like) and (mass >= fewest).all())
                    out.append((r.series_id, par.tolist(), list(r.par), float(like), not like - r.before >= tolerance, good))
                yield pd.DataFrame(out, columns=["series_id", "par", "used", "before", "done", "good"])

        schema = f"series_id {kind['series_id']}, par array<double>, used array<double>, before double, done boolean, good boolean"
        return hot.settled(given.mapInPandas(step, schema))

    found, left = [], fit_for.select("series_id")
    for kk, w, status in [(k, w, "ok") for w in WIDTHS] + ([(2, WIDTHS[0], "two states")] if k > 2 else []):
        params = hot.settled(start(w, kk).join(left.withColumnRenamed("series_id", "s5"), F.col("series_id").eqNullSafe(F.col("s5")), "left_semi"))
        ended = []
        for r in range(rounds):
            if params.isEmpty():
                break
            fit = maximised(params, worked(params, entered(params, kk), kk, "sums"), kk)
            over = F.col("done") if r < rounds - 1 else F.lit(True)
            ended.append(fit.filter(over).select("series_id", "used", "good"))
            params = hot.settled(fit.filter(~over).select("series_id", "par", "before"))
        if not ended:
            break
        every = ended[0]
        for e in ended[1:]:
            every = every.unionByName(e)
        every = hot.settled(every)
        # Probabilities are those of the last round, under the parameters that it began with.
        last = hot.settled(every.filter("good").select("series_id", F.col("used").alias("par")))
        if not last.isEmpty():
            found.append(worked(last, entered(last, kk), kk, "probabilities").withColumn("status", F.lit(status)))
        left = every.filter("not good").select("series_id")
    rest = left.unionByName(about.filter(~((F.col("n") >= 9) & (F.col("spread") > 1e-12))).select("series_id"))
    even = rows.join(rest.withColumnRenamed("series_id", "s6"), F.col("series_id").eqNullSafe(F.col("s6")), "left_semi")
    even = even.select("series_id", "dt", *(F.lit(1 / k).alias(f"{c}_{n}") for c in "pf" for n in NAMES[:k]), F.lit("uniform").alias("status"))
    for f in found:
        even = even.unionByName(f)
    return even
