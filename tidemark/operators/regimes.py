"""Markov-switching autoregressions of two or three states, fitted per series and window, many windows at once.

In state k a value follows level[k] + lag[k] * (the value before), with a deviation of its own.  The fit is by expectation
(a filter forwards, a smoother backwards) and maximisation (weighted least squares), from fixed starts.  A fit that fails,
because a state loses its rows or a number isn't finite, is tried again from wider starts, then with two states, and
ends with equal probabilities; `status` says which it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ("ranging", "trending", "crisis")
#: Widths of the deviations' starts that are tried, and windows that one task fits at once.
WIDTHS, TOGETHER = (2.0, 3.0, 5.0), 64


class Fit(NamedTuple):
    """Of each window, by state in ascending order of deviations: parameters, transitions, and probabilities of all rows but the first."""

    level: np.ndarray
    lag: np.ndarray
    deviation: np.ndarray
    move: np.ndarray
    filtered: np.ndarray
    smoothed: np.ndarray
    status: np.ndarray


def _em(x: np.ndarray, states: int, width: float, rounds: int, tolerance: float) -> tuple[np.ndarray, ...]:
    """Parameters and probabilities of windows x[window, row]; all windows go through each row together."""
    y, z = x[:, 1:], x[:, :-1]
    n, t = y.shape
    spread = y.std(axis=1)[:, None]
    scale = width ** np.linspace(-0.5, 0.5, states)
    level, lag, dev = np.repeat(y.mean(axis=1)[:, None], states, 1), np.zeros((n, states)), spread * scale
    move = np.full((n, states, states), 0.1 / max(1, states - 1))
    move[:, np.arange(states), np.arange(states)] = 0.9
    begin, before = np.full((n, states), 1 / states), np.full(n, -np.inf)
    ahead, back, size = np.empty((n, t, states)), np.ones((n, t, states)), np.empty((n, t))
    for _ in range(rounds):
        miss = y[:, :, None] - level[:, None] - lag[:, None] * z[:, :, None]
        log = -0.5 * (miss / dev[:, None]) ** 2 - np.log(dev)[:, None]
        top = log.max(axis=2)
        like = np.exp(log - top[:, :, None])
        now = begin * like[:, 0]
        for r in range(t):
            if r:
                now = (ahead[:, r - 1, None, :] @ move)[:, 0] * like[:, r]
            size[:, r] = now.sum(axis=1)
            ahead[:, r] = now / size[:, r, None]
        for r in range(t - 2, -1, -1):
            back[:, r] = (move @ (like[:, r + 1] * back[:, r + 1])[:, :, None])[:, :, 0] / size[:, r + 1, None]
        both = ahead * back
        both /= both.sum(axis=2, keepdims=True)
        pairs = move * np.einsum("nra,nrb->nab", ahead[:, :-1], like[:, 1:] * back[:, 1:] / size[:, 1:, None])
        move, begin = pairs / pairs.sum(axis=2, keepdims=True), both[:, 0]
        mass = both.sum(axis=1)
        mz, my = (np.einsum("nrk,nr->nk", both, v) / mass for v in (z, y))
        dz, dy = z[:, :, None] - mz[:, None], y[:, :, None] - my[:, None]
        vz = (both * dz * dz).sum(axis=1)
        lag = np.clip(np.where(vz > 0, (both * dz * dy).sum(axis=1) / np.where(vz > 0, vz, 1), 0), -0.99, 0.99)
        level = my - lag * mz
        miss = y[:, :, None] - level[:, None] - lag[:, None] * z[:, :, None]
        dev = np.maximum(np.sqrt((both * miss * miss).sum(axis=1) / mass), spread * 1e-3)
        total = (np.log(size) + top).sum(axis=1)
        if np.all(total - before < tolerance):
            break
        before = total
    return level, lag, dev, move, ahead, both


def switching_fit(x: np.ndarray, states: int = 3, rounds: int = 50, tolerance: float = 1e-6, fewest: float = 5.0) -> Fit:
    """Fits of windows of equal length, x[window, row]."""
    n, t = x.shape
    out = Fit(*(np.zeros((n, states)) for _ in range(3)), np.full((n, states, states), 1 / states), np.full((n, max(0, t - 1), states), 1 / states), np.full((n, max(0, t - 1), states), 1 / states), np.full(n, "uniform", object))
    out.level[:], out.deviation[:] = (x.mean(axis=1)[:, None], x.std(axis=1)[:, None]) if t else (0, 0)
    left = np.flatnonzero((t >= 10) & (out.deviation[:, 0] > 1e-12)) if t else np.zeros(0, int)
    ladder = [(states, w, "ok") for w in WIDTHS] + ([(2, WIDTHS[0], "two states")] if states > 2 else [])
    for k, width, status in ladder:
        if not len(left):
            break
        with np.errstate(all="ignore"):
            level, lag, dev, move, ahead, both = _em(x[left], k, width, rounds, tolerance)
        good = np.isfinite(dev).all(axis=1) & np.isfinite(move).all(axis=(1, 2)) & np.isfinite(both).all(axis=(1, 2)) & (both.sum(axis=1) >= fewest).all(axis=1)
        order = np.argsort(dev, axis=1, kind="stable")
        for i in np.flatnonzero(good).tolist():
            at, o = left[i], order[i]
            out.level[at, :k], out.lag[at, :k], out.deviation[at, :k] = level[i, o], lag[i, o], dev[i, o]
            out.move[at] = np.eye(states)
            out.move[at, :k, :k] = move[i][np.ix_(o, o)]
            for held, made in ((out.filtered, ahead), (out.smoothed, both)):
                held[at] = 0
                held[at, :, :k] = made[i][:, o]
            out.level[at, k:], out.lag[at, k:], out.deviation[at, k:] = np.nan, np.nan, np.nan
            out.status[at] = status
        left = left[~good]
    return out


def propagated(state: np.ndarray, move: np.ndarray, steps: int) -> np.ndarray:
    """Probabilities 1 to `steps` rows after a state, [step, state]."""
    out = np.empty((steps, len(state)))
    for s in range(steps):
        state = np.clip(state @ move, 0, 1)
        state = state / state.sum()
        out[s] = state
    return out


def _columns(states: int) -> str:
    return ", ".join(f"p_{k} double" for k in NAMES[:states])


def switching_probs(df: DataFrame, x: str, states: int = 3) -> DataFrame:
    """series_id, dt, smoothed and filtered (f_) probabilities and status from one fit of each whole series, in the order of dt."""
    kinds = dict(df.dtypes)
    filtered = _columns(states).replace("p_", "f_")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("dt", kind="stable")
        found = switching_fit(part["x"].to_numpy(float)[None, :], states)
        held = {f"{c}_{k}": p[0][:, i] for c, p in (("p", found.smoothed), ("f", found.filtered)) for i, k in enumerate(NAMES[:states])}
        return pd.DataFrame({"series_id": part["series_id"].to_numpy(object)[1:], "dt": part["dt"].to_numpy()[1:], **held, "status": found.status[0]})

    rows = df.filter(F.col(x).isNotNull()).select("series_id", "dt", F.col(x).alias("x"))
    return rows.groupBy("series_id").applyInPandas(fit, f"series_id {kinds['series_id']}, dt {kinds['dt']}, {_columns(states)}, {filtered}, status string")


def fold_regimes(train: DataFrame, x: str, by: Sequence[str] = ("series_id", "fold"), states: int = 3) -> DataFrame:
    """The keys of each fold with the smoothed probability of each state in its last training row, and status; a group is one window."""

    def fit(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = switching_fit(part.sort_values("dt", kind="stable")["x"].to_numpy(float)[None, :], states)
        last = found.smoothed[0][-1] if found.smoothed.shape[1] else np.full(states, 1 / states)
        return pd.DataFrame([(*keys, *last.tolist(), found.status[0])], columns=[*by, *NAMES[:states], "status"])

    kinds = dict(train.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), *(f"{n} double" for n in NAMES[:states]), "status string"])
    rows = train.filter(F.col(x).isNotNull()).select(*by, "dt", F.col(x).alias("x"))
    return rows.groupBy(*by).applyInPandas(fit, schema)


def rolling_regimes(df: DataFrame, x: str, train: int = 504, step: int = 21, states: int = 3) -> DataFrame:
    """series_id, dt, fold, the probability of each state and status of rows after each training window.

    Fold k trains on rows k*step+1 .. k*step+train and serves the next `step` rows by carrying its last state on.  The
    windows of TOGETHER folds of a series are one group, so no group grows with the series.  `df` has series_id, dt, rn
    (numbered from 1) and x.
    """
    k = F.col("rn") - 1
    low = F.greatest(F.lit(0), F.ceil((k - train - step + 1) / step)).cast("int")
    many = df.filter(F.col(x).isNotNull()).select("series_id", "dt", "rn", F.col(x).alias("x"), F.floor(low / TOGETHER).cast("int").alias("lo"), F.floor(F.floor(k / step) / TOGETHER).cast("int").alias("hi"))
    rows = many.withColumn("bundle", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    kinds = dict(df.dtypes)

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rn")
        at = part["rn"].to_numpy() - 1
        windows = []
        for fold in range(int(key[1]) * TOGETHER, (int(key[1]) + 1) * TOGETHER):
            a, b, c = np.searchsorted(at, [fold * step, fold * step + train, fold * step + train + step])
            if b - a == train and c > b:
                windows.append((fold, a, b, c))
        served = np.concatenate([np.zeros(0, int), *(np.arange(b, c) for _, _, b, c in windows)])
        size = [c - b for _, _, b, c in windows]
        later, status = [np.zeros((0, states))], []
        if windows:
            values = part["x"].to_numpy(float)
            found = switching_fit(np.stack([values[a:b] for _, a, b, _ in windows]), states)
            later += [propagated(found.filtered[i, -1], found.move[i], n) for i, n in enumerate(size)]
            status = np.repeat(found.status, size).tolist()
        later = np.concatenate(later)
        return pd.DataFrame({
            "series_id": pd.Series([key[0]] * len(served), dtype=object), "dt": part["dt"].to_numpy()[served], "fold": np.repeat([f for f, *_ in windows], size).astype(np.int32),
            **{f"p_{n}": later[:, j] for j, n in enumerate(NAMES[:states])}, "status": pd.Series(status, dtype=object),
        })

    return rows.groupBy("series_id", "bundle").applyInPandas(fit, f"series_id {kinds['series_id']}, dt {kinds['dt']}, fold int, {_columns(states)}, status string")
