"""Near-duplicates among embeddings by spherical-cap filters.

Filter directions are a structured random product code: a vector is rotated at random and cut into two halves, each
half has its own random codebook, and direction (i, j) joins codeword i of the first half with codeword j of the
second.  A vector is filed under every direction whose inner product with it exceeds `cap`; list decoding finds them
without trying all pairs of codewords: codewords of a half are tried in the order of their scores, and a codeword of
the first half is dropped as soon as the best one of the second can't lift it over the cap.  Vectors that share a
filter are compared in double precision.

Rotated at random, a vector's inner product with a direction follows the exact law of the sphere (a beta law), and so do
those of a pair.  From these tails `plan` takes a cap at which a filter holds about as many vectors at any size
(`per_filter`) and the number of codewords at which a pair at the threshold shares `shared` filters on average.  Filters of
one code share codewords, so a pair may well share none of them: a code's chance of that is measured on random pairs at the
threshold, for these very numbers, and codes with rotations and codebooks of their own are added until the chance that
all of them miss a pair is under `miss`.

Equal vectors are filed once, by their bytes.  Filters are dealt in rounds, range after range of their numbers, since a vector
goes to each of its filters: a round holds about `COPIES` of each vector (with the numbers of its filters before this one), and
its shuffle is deleted before the next one begins, so disk follows the vectors and not their filters.  A filter with more than
`block` vectors is split into blocks, and every pair of blocks is one group, so that no task holds a hot filter and none is cut
short.  Groups give no pairs: only each vector's count of links whose first common filter is this one, and the links of a
spanning forest.

Defined results: a vector that is null, zero, or holds null or non-finite components links with nothing, itself
included, and is kept; vectors link only with vectors of their own length; repeated ids count as vectors of their own, and
the smallest id of a component names it (a null id does so only where all of its ids are null); other columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.grouped import map_groups
from tidemark.llm.stage import discard, settle

#: Hot filters that are broadcast at most; beyond it, a join does the same.
BROADCAST_ROWS = 200_000
#: Copies of a vector in a round of filters, and copies of all vectors that a round has at least.
COPIES, DEALT = 2, 1 << 18
#: Codes at least, filters of a vector on average at most, and filters at most, as codebooks must stay small: with vectors
#: beyond that, filters hold more of them.
CODES, FILED, MOST = 16, 256, 1 << 29


def tail(cap: float, dim: int) -> float:
    """P(X > cap) of a random direction's inner product with a unit vector."""
    if cap >= 1:
        return 0.0
    if cap <= -1:
        return 1.0
    if dim == 1:
        return 0.5
    turn = math.acos(cap)
    return _arc(0, turn, dim) / (_arc(0, turn, dim) + _arc(turn, math.pi, dim))


def _arc(low: float, high: float, dim: int, n: int = 2000) -> float:
    """The integral of sin ** (dim - 2), by Simpson's rule."""
    x = np.linspace(low, high, n + 1)
    weight = np.where(np.arange(n + 1) % 2, 4.0, 2.0)
    weight[[0, -1]] = 1
    return float((np.sin(x).clip(0) ** (dim - 2) * weight).sum() * (high - low) / n / 3)


def both_tail(cap: float, rho: float, dim: int) -> float:
    """P(X > cap and X' > cap) of a random direction's inner products with two unit vectors whose own is rho."""
    if rho >= 1 or dim == 1:
        return tail(cap, dim)
    turn, s, n = math.acos(cap), math.sqrt(1 - rho * rho), 400
    # At an angle of x to the first vector, the rest of the direction is uniform on a sphere of a dimension less.
    x = (np.arange(n) + 0.5) * turn / n
    rest = np.array([tail((cap - rho * math.cos(t)) / (s * math.sin(t)), dim - 1) for t in x])
    return float((np.sin(x) ** (dim - 2) * rest).sum() * turn / n / (_arc(0, turn, dim) + _arc(turn, math.pi, dim)))


def plan(count: int, dim: int, threshold: float, per_filter: float, shared: float, top: float = 1.0) -> tuple[int, float]:
    """Codewords of a half of each of CODES codes, and the cap (an inner product with a unit direction), at most `top`."""
    low, high = 0.0, top
    for _ in range(40):
        cap = (low + high) / 2
        one = tail(cap, dim)
        both = both_tail(cap, threshold, dim) if count * one >= per_filter else 0
        # In few dimensions small caps of two near vectors hardly meet, so a cap may hold more than `per_filter` vectors.
        fits = both > 0 and shared * one <= FILED * both and shared <= MOST * both
        low, high = (cap, high) if fits else (low, cap)
    return max(2, math.ceil(math.sqrt(shared / CODES / both_tail(low, threshold, dim)))), low


def missed(dim: int, words: int, cap: float, threshold: float, pairs: int = 2000, seed: int = 1) -> float:
    """The chance that a pair at the threshold shares no filter of a code, measured (and set high by three of its standard errors)."""
    rng, books, lost = np.random.default_rng([seed, dim]), 8, 0
    for b in range(books):
        x, y = rng.standard_normal((2, pairs // books, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if dim > 1:
            y -= (x * y).sum(axis=1, keepdims=True) * x
            y = threshold * x + math.sqrt(max(0, 1 - threshold * threshold)) * y / np.linalg.norm(y, axis=1, keepdims=True)
        else:
            y = x
        code = Code(dim, words, cap, seed + b)
        lost += sum(not len(np.intersect1d(p, q, True)) for p, q in zip(code.decode(x), code.decode(y), strict=True))
    p = (lost + 1) / (pairs + 2)
    return min(0.99, p + 3 * math.sqrt(p * (1 - p) / pairs))


class Code:
    """The product code of one dimension."""

    def __init__(self, dim: int, words: int, cap: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0] if dim > 1 else np.ones((1, 1))
        self.cut = dim // 2
        self.cap = cap
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        self.one = unit(rng.standard_normal((words, max(1, self.cut)))) * math.sqrt(self.cut / dim if self.cut else 0)
        self.two = unit(rng.standard_normal((words, dim - self.cut))) * math.sqrt((dim - self.cut) / dim)
        self.words = words

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted numbers of the filters that each row exceeds."""
        x = x @ self.turn
        first = x[:, : self.cut] @ self.one.T if self.cut else np.zeros((len(x), self.words))
        second = x[:, self.cut :] @ self.two.T
        order, best = np.argsort(-second, axis=1), second.max(axis=1)
        out = []
        for r in range(len(x)):
            live = np.flatnonzero(first[r] + best[r] > self.cap)
            ranked = second[r, order[r]]
            sizes = np.searchsorted(-ranked, first[r, live] - self.cap, "left")
            rows = np.repeat(live, sizes)
            ranks = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out.append(np.sort(rows * self.words + order[r][ranks]))
        return out


def number_kind(words: int, number: int) -> type:
    """The type that holds the numbers of all filters of `number` codes."""
    return np.int32 if number * words**2 < 1 << 31 else np.int64


class Codes:
    """`number` product codes of one dimension, each with a rotation and codebooks of its own."""

    def __init__(self, dim: int, words: int, cap: float, number: int, seed: int):
        self.codes = [Code(dim, words, cap, seed * 10_000 + k) for k in range(number)]
        self.kind = number_kind(words, number)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted numbers of the filters that each row exceeds, over all codes."""
        of = [code.decode(x) for code in self.codes]
        return [np.concatenate([f[r] + k * code.words**2 for k, (f, code) in enumerate(zip(of, self.codes, strict=True))]).astype(self.kind) for r in range(len(x))]


def codes_for(count: int, dim: int, threshold: float, per_filter: float, shared: float, miss: float) -> tuple[int, float, int]:
    """Codewords of a half, the cap, and the number of codes that together miss a pair at the threshold with a chance under `miss`."""
    words, cap = plan(count, dim, threshold, per_filter, shared)
    # Codebooks of few dimensions have few directions, so that codes would be added without end: wider caps instead.
    while (p := missed(dim, words, cap, threshold)) > 0.75 and cap > 0.01:
        words, cap = plan(count, dim, threshold, per_filter, shared, cap * 0.9)
    return words, cap, max(CODES, math.ceil(math.log(miss) / math.log(p)))


def rounds(counts: dict[int, int], dims: dict[int, tuple[int, float, int]]) -> list[tuple[int, int]]:
    """Ranges of filter numbers to be dealt one after the other, from the number of vectors and the codes of each dimension."""
    every = sum(c * dims[d][2] * dims[d][0] ** 2 * tail(dims[d][1], d) for d, c in counts.items())
    number = max(1, min(math.ceil(every / max(1, sum(counts.values())) / COPIES), int(every // DEALT)))
    top = max((words**2 * codes for words, _, codes in dims.values()), default=1)
    ends = [top * k // number for k in range(number + 1)]
    return [(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True) if a < b]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows are scaled by their largest component first, as squares of very large or small ones aren't numbers."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between nodes 0..n-1."""
    top = np.arange(n)
    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while top[x] != x:
            top[x] = top[top[x]]
            x = int(top[x])
        while top[y] != y:
            top[y] = top[top[y]]
            y = int(top[y])
        if x != y:
            top[max(x, y)] = min(x, y)
            kept.append((x, y))
    return kept


def met_before(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray, number: int, step: int = 2048) -> np.ndarray:
    """Which rows of `left` and `right` share a filter before `number`, from products of their membership matrices."""
    before = [x[: np.searchsorted(x, number)] for x in lists]
    rows = np.repeat(np.arange(len(before)), [len(x) for x in before])
    out = np.zeros((len(left), len(right)), bool)
    if not len(rows):
        return out
    names, cols = np.unique(np.concatenate(before), return_inverse=True)
    for start in range(0, len(names), step):
        some = (cols >= start) & (cols < start + step)
        member = np.zeros((len(lists), min(step, len(names) - start)), np.float32)
        member[rows[some], cols[some] - start] = 1
        out |= member[left] @ member[right].T > 0.5
    return out


def compare(number: int, k1: int, k2: int, k: np.ndarray, u: np.ndarray, n: np.ndarray, x: np.ndarray, fs: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and links of one pair of blocks: (u, u, links) of vectors whose first common filter is this one, and a forest with 0 links."""
    left, right = np.flatnonzero(k == k1), np.flatnonzero(k == k2)
    near = x[left] @ x[right].T >= threshold
    if k1 == k2:
        near = np.triu(near, 1)
    keep, meet = near.any(axis=1), near.any(axis=0)
    left, right, near = left[keep], right[meet], near[np.ix_(keep, meet)]
    if not len(left):
        none = np.zeros(0, np.int64)
        return none, none, none
    a, b = np.nonzero(near)
    tree = np.array(forest(left[a], right[b], len(u)), np.int64)
    used, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    near &= ~met_before([fs[r] for r in used], at[: len(left)], at[len(left) :], number)
    links = np.zeros(len(u), np.int64)
    links[left] += near @ n[right]
    links[right] += near.T @ n[left]
    some = np.flatnonzero(links)
    return np.concatenate([u[some], u[tree[:, 0]]]), np.concatenate([u[some], u[tree[:, 1]]]), np.concatenate([links[some], np.zeros(len(tree), np.int64)])


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, per_filter: float = 200, shared: float = 32, block: int = 1024, seed: int = 0, miss: float = 1e-5) -> DataFrame:
    """key, n_links, component_id and kept of every row; `df` is read twice."""
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = good & F.exists(vector, lambda x: x != 0)
    # Floats stay floats where they are kept or dealt; all arithmetic is on doubles.
    single = dict(df.dtypes)[vector] == "array<float>"
    rows = df.select(F.col(key).alias("id"), F.when(sound, F.col(vector) if single else F.col(vector).cast("array<double>")).alias("v"))
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.unhex(F.sha2(F.to_json(F.struct("v")), 256))))
    reps = rows.filter("h is not null").groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    reps = settle(reps.select("h", "rep", "n", F.xxhash64("h").alias("u"), "v"), clear=True)
    counts = {r["d"]: r["c"] for r in reps.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).collect()}
    dims = {d: codes_for(c, d, threshold, per_filter, shared, miss) for d, c in counts.items()}

    wide = any(number_kind(words, number) is np.int64 for words, _, number in dims.values())
    kind, width = (pa.int64(), np.int64) if wide else (pa.int32(), np.int32)
    raw = np.float32 if single else np.float64

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Codes] = {}
        for batch in batches:
            vectors = [np.asarray(v, float) for v in batch.column("v").to_pylist()]
            for d in {len(v) for v in vectors}:
                at = [r for r, v in enumerate(vectors) if len(v) == d]
                if d not in codes:
                    codes[d] = Codes(d, *dims[d], seed)
                for s in range(0, len(at), 512):
                    part = at[s : s + 512]
                    x = np.stack([vectors[r] for r in part])
                    found = codes[d].decode(unit(x))
                    ends = np.cumsum([0, *(len(f) for f in found)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(width), kind))
                    kept = [batch.column(c).take(pa.array(part)) for c in ("h", "rep", "n", "u")]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(np.full(len(part), d, np.int32)), pa.array([v.tobytes() for v in x.astype(raw)], pa.binary()), lists],
                        names=["h", "rep", "n", "u", "d", "v", "fs"],
                    )

    # Vectors are filed once; what follows reads their lists.
    coded = settle(reps.mapInArrow(file, f"h binary, rep {dict(reps.dtypes)['rep']}, n long, u long, d int, v binary, fs array<{'long' if wide else 'int'}>"), clear=True)
    discard(reps)
    # Only filters that need more than one block are looked up: one for each `block` filed rows at most.
    hot = coded.select("d", F.explode("fs").alias("f")).groupBy("d", "f").count().filter(F.col("count") > block)
    hot = settle(hot.select(F.col("d").alias("d2"), F.col("f").alias("f2"), F.ceil(F.col("count") / block).cast("int").alias("blocks")), clear=True)
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot

    def dealt(low: int, high: int) -> DataFrame:
        """The vectors of the filters from `low` to `high`, a vector of block k with every block: groups (min, max) of block numbers."""
        filed = coded.select("d", F.posexplode("fs").alias("p", "f"), "u", "n", "v", "fs").filter((F.col("f") >= low) & (F.col("f") < high))
        return (
            filed.join(hot, (F.col("d") == F.col("d2")) & (F.col("f") == F.col("f2")), "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("k", F.pmod(F.xxhash64("u", "f"), F.col("blocks")).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("d", "f", F.least("k", "o").alias("k1"), F.greatest("k", "o").alias("k2"), "k", "u", "n", "v", F.slice("fs", 1, F.col("p")).alias("fs"))
        )

    def whole(table: pa.Table) -> pa.RecordBatch:
        """Compares every group of a table of whole groups."""
        d, f, k1, k2, k, u, n = (table.column(c).to_numpy() for c in ("d", "f", "k1", "k2", "k", "u", "n"))
        v, lists = table.column("v").to_pylist(), table.column("fs").combine_chunks()
        ends, numbers = lists.offsets.to_numpy(), lists.values.to_numpy()
        fs = [numbers[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        new = np.flatnonzero((np.diff(d) != 0) | (np.diff(f) != 0) | (np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
        parts = []
        for s, e in zip([0, *new.tolist()], [*new.tolist(), len(f)], strict=True):
            if e - s > 1:
                x = unit(np.frombuffer(b"".join(v[s:e]), raw).reshape(e - s, -1).astype(float))
                parts.append(compare(int(f[s]), int(k1[s]), int(k2[s]), k[s:e], u[s:e], n[s:e], x, fs[s:e], threshold))
        columns = [np.concatenate([np.zeros(0, np.int64), *(p[c] for p in parts)]) for c in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

    found = None
    for low, high in rounds(counts, dims):
        part = map_groups(dealt(low, high), ["d", "f", "k1", "k2"], whole, "a long, b long, links long").groupBy("a", "b").agg(F.sum("links").alias("links"))
        part = settle(part, clear=True)
        found = part if found is None else found.unionByName(part)
    found = settle(found.groupBy("a", "b").agg(F.sum("links").alias("links")), clear=True)
    counts = found.filter("a = b").select(F.col("a").alias("cu"), "links")
    # Components go by vector, as different vectors may share an id; each is named by its smallest id.
    named = coded.select("h", "rep", "n", "u").join(components(found.filter("a <> b").select("a", "b")), F.col("u") == F.col("node"), "left").withColumn("c", F.coalesce("component", "u"))
    names = named.groupBy(F.col("c").alias("c2")).agg(F.min("rep").alias("component_id"))
    per = (
        named.join(names, F.col("c") == F.col("c2"))
        .join(counts, F.col("u") == F.col("cu"), "left")
        .select(F.col("h").alias("__h"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    )
    return rows.join(per, F.col("h") == F.col("__h"), "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"),
    )
