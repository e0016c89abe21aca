"""Periodic runs of words, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that holds at least `times`
periods and `least` words and that no neighbouring word extends.  With a run of three periods or more, some block of
2 ** k words that begins at a multiple of 2 ** k lies in it together with its copy q words on, where 2 ** k <= q < 2 ** (k + 1);
periods of under 8 words show in blocks of 8, as runs have 24 words at least.  So for each k

1. the suffix array of the words, sorted by prefix doubling as far as 2 ** k words, gives the interval of a block's occurrences;
2. a wavelet tree over the suffix array answers which of them begin in the neighbouring window: how many begin before a
   place, and the first from there on (range successor);
3. occurrences that begin within 2 ** k words make an arithmetic progression.  One or two give their distances as candidate
   periods.  Three or more have the block's own period d as difference: the stretches of period d around the block and
   around its copies end where the run's period carries one end to the other, which leaves two candidates;
4. a candidate is extended word by word to both sides as far as words q apart agree.

Words count as different in different documents, so documents of a batch share one array and no run leaves its document.
It takes one scan, without a shuffle; a document's work is about n log n for n words, however periodic it is.

Defined results: a null text has no words and stays null where collapsed; stretches that are runs with several periods
count with the smallest; runs may overlap; words are maximal runs of `[^\\x20\\x09-\\x0D]`, known by 64-bit hashes within a
document; repeated rows are alike; other columns are kept, but those added replace columns of the same name; an empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as B

#: Words of the smallest block.
BLOCK = 8


class Wavelet:
    """Bits of numbers, from the highest on, each level parted stably by the bit before: order statistics of intervals."""

    def __init__(self, values: np.ndarray, most: int):
        self.levels = []
        v = values.astype(np.int32)
        for bit in range(max(1, int(most).bit_length()) - 1, -1, -1):
            one = (v >> bit & 1).astype(bool)
            zeros = np.zeros(len(v) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros))
            v = np.concatenate([v[~one], v[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in [lo, hi) are under x."""
        lo, hi, out = lo.astype(np.int64), hi.astype(np.int64), np.zeros(len(lo), np.int64)
        x = np.minimum(x, (2 << self.levels[0][0]) - 1)
        for bit, zeros in self.levels:
            a, b, one = zeros[lo], zeros[hi], (x >> bit & 1).astype(bool)
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return out

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value in [lo, hi) that k others are under."""
        lo, hi, k, out = lo.astype(np.int64), hi.astype(np.int64), k.copy(), np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            k -= np.where(one, b - a, 0)
            out |= one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return out


def suffixes(symbols: np.ndarray, most: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array by the first `most` symbols or more, and by length of blocks: places, and interval, of those that occur again.

    The last symbol must be there once.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    s = symbols[sa]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    # Slots of the suffix array whose suffixes are not told apart yet.
    slot = np.flatnonzero(~(new & np.append(new[1:], True)))
    blocks, length = {}, 1
    while True:
        if length >= BLOCK:
            at = sa[slot]
            on = at % length == 0
            lo = rank[at[on]]
            start, size = np.unique(rank[at], return_counts=True)
            blocks[length] = at[on], lo, lo + size[np.searchsorted(start, lo)]
        if not len(slot) or length >= most:
            return sa, blocks
        at = sa[slot]
        key = rank[at] * (n + 1) + rank[at + length]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[slot] = at
        new = np.ones(len(slot), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = slot[np.maximum.accumulate(np.where(new, np.arange(len(slot)), 0))]
        slot = slot[~(new & np.append(new[1:], True))]
        length *= 2


def stretch(s: np.ndarray, i: int, j: int, t: int) -> tuple[int, int]:
    """The longest stretch around [i, j) in which symbols t apart agree."""
    step, n = 64, len(s)
    while i > 0:
        k = max(0, i - step)
        differ = np.flatnonzero(s[k:i] != s[k + t : i + t])
        if len(differ):
            i = k + int(differ[-1]) + 1
            break
        i, step = k, step * 2
    step = 64
    while j < n:
        k = min(n, j + step)
        differ = np.flatnonzero(s[j:k] != s[j - t : k - t])
        if len(differ):
            j += int(differ[0])
            break
        j, step = k, step * 2
    return i, j


class Stretches:
    """Stretches by period, each extended once."""

    def __init__(self, s: np.ndarray):
        self.s = s
        self.known: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def around(self, i: int, j: int, t: int) -> tuple[int, int]:
        known = self.known[t]
        k = bisect_right(known, (i, len(self.s) + 1)) - 1
        if k >= 0 and known[k][1] >= j:
            return known[k]
        found = stretch(self.s, i, j, t)
        insort(known, found)
        return found


def find_runs(symbols: np.ndarray, longest: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """start, end and smallest period of all runs; `symbols` ends with one that is there once, no run has over `longest`."""
    sa, blocks = suffixes(symbols, longest // times)
    tree = None
    known = Stretches(symbols)
    found: dict[tuple[int, int], int] = {}
    for length, (at, lo, hi) in blocks.items():
        if not len(at):
            continue
        tree = tree or Wavelet(sa, len(symbols))
        for near, far in ([(1, length)] if length == BLOCK else []) + [(length, 2 * length)]:
            before = tree.below(lo, hi, at + near)
            count = tree.below(lo, hi, at + far) - before
            on = np.flatnonzero(count)
            if not len(on):
                continue
            b, l, h, k, m = at[on], lo[on], hi[on], before[on], count[on]
            first = tree.nth(l, h, k)
            if near < length:
                # Nearer than the block is long, only the first copy can be a period away.
                tries = list(zip(b.tolist(), (first - b).tolist(), strict=True))
            else:
                second = np.where(m > 1, tree.nth(l, h, np.where(m > 1, k + 1, k)), first)
                last = tree.nth(l, h, k + m - 1)
                tries = []
                for x, y, z, e, c in zip(b.tolist(), first.tolist(), second.tolist(), last.tolist(), m.tolist(), strict=True):
                    if c < 3:
                        tries += [(x, y - x)] + ([(x, z - x)] if c == 2 else [])
                        continue
                    d = z - y
                    own, copy = known.around(x, x + length, d), known.around(y, e + length, d)
                    tries += [(x, t) for t in {copy[0] - own[0], copy[1] - own[1]} if y - x <= t <= e - x and (t - (y - x)) % d == 0]
            for x, t in sorted(tries, key=lambda p: (p[1], p[0])):
                run = known.around(x, x + length + t, t)
                if run[1] - run[0] >= max(least, times * t):
                    found[run] = min(t, found.get(run, t))
    return sorted((s, e, t) for (s, e), t in found.items())


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_KIND = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def collapse(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Adds n_words, runs (by start, then period) and collapsed: the words, parted by single spaces, that no run holds after its first period."""
    if least < 3 * BLOCK or times < 3:
        raise ValueError("runs have 24 words and 3 periods at least")
    added = ["n_words", "runs", "collapsed"]
    df = docs.drop(*added)
    names = df.columns
    at = names.index(text)
    schema = df.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast(RUNS), "collapsed": F.lit(None).cast("string")}).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
            for i, j, data, offs in B.chunks(batch.column(at), 2 << 20):
                w = B.Words(data, offs, B.SOLID, lower=False)
                rows = j - i
                own = B.mixed(w.hashes() + w.doc.astype(np.uint64) * B._R)
                symbols = np.append(np.unique(own, return_inverse=True)[1], len(own))
                runs: list[list[dict]] = [[] for _ in range(rows)]
                gone = np.zeros(len(own) + 1, np.int32)
                for s, e, t in find_runs(symbols, int(w.count.max(initial=0)), least, times):
                    r = int(w.doc[s])
                    runs[r].append({"start": s - int(w.at[r]), "length": e - s, "period": t})
                    gone[s + t] += 1
                    gone[e] -= 1
                dead = np.cumsum(gone[:-1]) > 0
                spaced, begin = w.spaced()
                ends = np.append(begin, len(spaced))
                stay = np.repeat(~dead, np.diff(ends))
                sizes = np.zeros(len(stay) + 1, np.int64)
                np.cumsum(stay, out=sizes[1:])
                kept = spaced[stay].tobytes()
                cuts = sizes[ends[w.at]].tolist()
                # The space after the last word goes.
                texts = [None if null[i + r] else kept[cuts[r] : max(cuts[r], cuts[r + 1] - 1)] for r in range(rows)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, rows) for c in batch.columns), pa.array(w.count), pa.array(runs, _KIND), pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, *added]
                )

    return df.mapInArrow(scan, schema)
