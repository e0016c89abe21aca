"""N-gram Jaccard join by chosen paths.

Documents are sets of shingles (n consecutive words, lower-cased).  Each set has a signature of `COORDS` minhash
tokens.  In one run every set walks down a tree: a node samples one token position, and sets that share the token
there go to the same child.  A node with at most `BRUTE` sets is compared by brute force on the signatures; a larger
one is split again, to depth `DEPTHS[-1]`.  Two sets with Jaccard similarity s stay together for d levels with
probability s ** d, so the run is repeated, each time with other samples, until the recall asked for is met.  The
first runs meet it for depth 3; sets whose nodes went deeper have more parts of runs, each with minhash tokens of its
own, as many as their depth needs.

What the runs find are candidates: links of a forest over each node, and a node that no depth splits is taken as one
candidate group whole.  Candidate groups are then compared exactly, set by set, in blocks if they are large; so links
are never decided by an estimate, and pairs of a group are never written out: only each set's count of links and a
forest of them.

Sets of equal word sequences are one set with a multiplicity.  Shared-nothing tasks: no task holds a node of more than
`BRUTE` sets, or more than two blocks of a group.

Defined results: a document of fewer words than n, but not none, is one shingle; one without words (null, empty)
links with nothing and is its own class; repeated rows are copies; a null key is never a class's name unless all of its
documents have null keys; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as B
from tidemark.llm.capfilter import forest
from tidemark.llm.graph import components
from tidemark.llm.grouped import map_groups
from tidemark.llm.stage import settle

COORDS, BRUTE = 64, 4096
#: Sets of a node whose pairs are compared all at once.
FEW = 128
#: Runs that go to the last depth at once, before the others.
HEAD = 4
#: Depths at which nodes are counted.
DEPTHS = (1, 3, 6, 12)
#: The depth for which the first runs are enough.
FIRST = 3
#: Sets, and bytes of shingles, of a block of a candidate group.
BLOCK, BLOCK_BYTES = 2048, 48 << 20
#: Keys that are broadcast at most; beyond it, a join does the same.
BROADCAST_ROWS = 1_000_000


def runs_for(recall: float, similarity: float, depth: int = 3) -> int:
    """Runs after which a pair that must share `depth` tokens has been together at least once, with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


def parts_for(recall: float, similarity: float, depth: int, runs: int) -> int:
    """Parts of `runs` runs, each on COORDS tokens of its own, after which a pair that must share `depth` tokens has been together, with probability `recall`."""
    k = range(COORDS + 1)
    apart = sum(math.comb(COORDS, i) * similarity**i * (1 - similarity) ** (COORDS - i) * (1 - (i / COORDS) ** depth) ** runs for i in k)
    return math.ceil(math.log(1 - recall) / math.log(apart))


class Sets:
    """Shingle hashes of a chunk's documents, and the first of each (with the end of the last)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, n: int):
        w = B.Words(data, offs, B.SOLID)
        h = w.hashes()
        first, got = B.windows(h, w.doc, n)
        doc = w.doc[first]
        short = np.flatnonzero((w.count > 0) & (w.count < n))
        self.words = w.count
        # The hash of a document's whole word sequence, and of the one shingle of a short one.
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * B.powers(B._Q, len(h)), out=total[1:])
        whole = (total[w.at[1:]] - total[w.at[:-1]]) * B.powers(B._QI, len(h) + 1)[w.at[:-1]]
        self.whole = B.mixed(whole ^ w.count.astype(np.uint64)).view(np.int64)
        if len(short):
            got, doc = np.concatenate([got, self.whole[short].view(np.uint64)]), np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            got, doc = got[order], doc[order]
        self.hash = got
        self.at = np.searchsorted(doc, np.arange(len(offs)))

    def signatures(self, seed: int = 0) -> np.ndarray:
        """Rows of COORDS 32-bit minhash tokens, of documents with words."""
        rows = np.flatnonzero(self.words > 0)
        out = np.zeros((len(rows), COORDS), np.uint32)
        if len(rows):
            rng = np.random.default_rng([seed, 5])
            a = rng.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            b = rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)
            space = np.empty_like(self.hash)
            for c in range(COORDS):
                np.multiply(self.hash, a[c], out=space)
                np.bitwise_xor(space, b[c], out=space)
                out[:, c] = np.minimum.reduceat(space, self.at[rows]) >> np.uint64(32)
        return out


def step(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The child to which each set goes: the node's own sampled position, and the set's token there."""
    c = (B.mixed(node) >> np.uint64(40)) % np.uint64(COORDS)
    token = np.take_along_axis(sig, c.astype(np.int64)[:, None], 1)[:, 0].astype(np.uint64)
    return B.mixed(node * np.uint64(0x9E3779B97F4A7C15) ^ (token + (c << np.uint64(32))))


def _features(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, u (hash of the word sequence; null without words) and sig of every row."""
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in B.chunks(batch.column(1), B.PIECE):
                s = Sets(data, offs, n)
                none = s.words == 0
                sig = s.signatures()
                rows = iter(sig)
                packed = [None if x else next(rows).tobytes() for x in none.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s.whole, mask=none), pa.array(packed, pa.binary())], names=["key", "u", "sig"])

    schema = docs.select(F.col(key).alias("key"), F.lit(0).cast("long").alias("u"), F.lit(b"").alias("sig")).schema
    assert schema["key"].dataType == kind
    return docs.select(F.col(key).alias("key"), text).mapInArrow(emit, "key " + kind.simpleString() + ", u long, sig binary")


def _sig(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of tokens from fixed-size binaries."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint32).reshape(len(rows), COORDS)


def _alike(table: pa.Table, least: int) -> pa.RecordBatch:
    """Forests of the pairs of each node, of different components, whose signatures agree in `least` places or more."""
    node, u, c = (table.column(k).to_numpy() for k in ("node", "u", "c"))
    sig = _sig(table.column("sig")).astype(np.uint8)
    bounds = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
    sizes = np.diff(bounds)
    out: list[np.ndarray] = []
    for m in np.unique(sizes).tolist():
        if m < 2:
            continue
        starts = bounds[:-1][sizes == m]
        if m > FEW:
            out += [found for s in starts.tolist() if len(found := _crowd(sig[s : s + m], u[s : s + m], c[s : s + m], least))]
            continue
        p, q = np.triu_indices(m, 1)
        per = max(1, (1 << 18) // len(p))
        for k in range(0, len(starts), per):
            a = (starts[k : k + per, None] + p).ravel()
            b = (starts[k : k + per, None] + q).ravel()
            apart = c[a] != c[b]
            a, b = a[apart], b[apart]
            near = (sig[a] == sig[b]).sum(1) >= least
            a, b = a[near], b[near]
            if m == 2:
                out.append(np.stack([u[a], u[b]], 1))
                continue
            base = np.searchsorted(starts, a, "right") - 1
            for g in np.unique(base).tolist():
                on = base == g
                tree = forest(a[on] - starts[g], b[on] - starts[g], m)
                if tree:
                    out.append(u[np.array(tree) + starts[g]])
    pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _crowd(sig: np.ndarray, u: np.ndarray, c: np.ndarray, least: int) -> np.ndarray:
    """The same of one node of many sets: a set is compared only with those of other components, the ones found here included."""
    top = np.unique(c, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for i in range(len(u) - 1):
        rest = np.flatnonzero(top[i + 1 :] != top[i]) + i + 1
        if not len(rest):
            continue
        near = rest[(sig[rest] == sig[i]).sum(1) >= least]
        _, first = np.unique(top[near], return_index=True)
        for j in near[first].tolist():
            out.append((int(u[i]), int(u[j])))
            top[top == top[j]] = top[i]
    return np.array(out, np.int64).reshape(-1, 2)


def candidates(sets: DataFrame, similarity: float, recall: float, more: Callable[[DataFrame], DataFrame], seed: int = 0) -> DataFrame:
    """Links (a, b) whose components hold every pair that the runs bring together.

    `sets` has u and sig; `more` gives u, part and sig of the parts low to high (exclusive) of each row of u, low and high.
    """
    runs = runs_for(recall, similarity)
    need = {d: max(1, parts_for(recall, similarity, d, runs)) for d in DEPTHS if d > FIRST}
    links = settle(_straight(sets.select("u", "sig"), seed))
    known = components(links, clean=True)
    found, deep = _walk(_named(sets.select("u", F.lit(0).alias("part"), "sig"), known), similarity, runs, seed)
    links = links.union(found)
    had: DataFrame | None = None
    while deep is not None:
        links = settle(links)
        known = components(links, clean=True)
        wanted = _apart(deep, known).withColumn("high", F.create_map(*(F.lit(x) for e in need.items() for x in e))[F.col("depth")]).drop("depth")
        if had is None:
            wanted = wanted.withColumn("low", F.lit(1))
        else:
            wanted = wanted.join(had.select(F.col("u").alias("u1"), F.col("high").alias("low")), F.col("u") == F.col("u1"), "left").drop("u1").withColumn("low", F.coalesce("low", F.lit(1)))
        had = settle(wanted.filter("high > low").select("u", "low", "high"))
        if had.isEmpty():
            break
        # A pair that was in one deep node has both of its sets in the same parts, up to the smaller need of the two.
        found, deep = _walk(settle(_named(more(had), known)), similarity, runs, seed)
        links = links.union(found)
    return links


def _named(sets: DataFrame, known: DataFrame) -> DataFrame:
    """Adds c, the component that a set is in so far."""
    return sets.join(known.withColumnRenamed("node", "u1"), F.col("u") == F.col("u1"), "left").withColumn("c", F.coalesce("component", "u")).drop("u1", "component")


def _straight(sets: DataFrame, seed: int) -> DataFrame:
    """Links (a, b) of the sets that share a node of the last depth in one of HEAD runs, to which all go at once.

    These are the candidate groups of nodes that no depth splits: groups of near copies are joined before the runs that
    count their nodes, so that nodes which hold no other sets are passed over there.
    """
    roots = np.arange(1, HEAD + 1, dtype=np.uint64) + np.uint64(seed * 1000 + 500)

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = _sig(batch.column(1))
                nodes = []
                for r in roots:
                    node = np.full(len(sig), r)
                    for _ in range(DEPTHS[-1]):
                        node = step(node, sig)
                    nodes.append(node.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.tile(batch.column(0).to_numpy(), HEAD))], names=["node", "u"])

    at = settle(sets.mapInArrow(fall, "node long, u long"))
    low = at.groupBy("node").agg(F.min("u").alias("a"), F.max("u").alias("top")).filter("a < top").select(F.col("node").alias("node2"), "a")
    return at.join(low, F.col("node") == F.col("node2")).select("a", F.col("u").alias("b")).filter("a <> b").distinct()


def _apart(deep: DataFrame, joined: DataFrame) -> DataFrame:
    """u and the greatest depth of sets in deep nodes whose sets aren't all in one component yet.

    Sets of one component are compared whatever more runs find, so a node of one group of near copies is done.
    """
    named = deep.join(joined.withColumnRenamed("node", "u1"), F.col("u") == F.col("u1"), "left").withColumn("c", F.coalesce("component", "u"))
    mixed = named.groupBy("node").agg(F.min("c").alias("low"), F.max("c").alias("top")).filter("low <> top").select(F.col("node").alias("node2"))
    return deep.join(mixed, F.col("node") == F.col("node2")).groupBy("u").agg(F.max("depth").alias("depth"))


def _walk(sets: DataFrame, similarity: float, runs: int, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) of all runs of each part; and node, u and depth of the sets of nodes that went deeper than FIRST.  `sets` has u, part, sig and c."""
    # A pair at the threshold agrees in fewer places than this about once in 1e5.
    least = max(1, math.floor(COORDS * similarity - 4.4 * math.sqrt(COORDS * similarity * (1 - similarity))))
    roots = np.arange(1, runs + 1, dtype=np.uint64) + np.uint64(seed * 1000 + 77)
    places = [f"d{k}" for k in range(len(DEPTHS))]

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u, part, c = (batch.column(k).to_numpy() for k in (0, 1, 3))
            sig, nodes = _sig(batch.column(2)), [[] for _ in places]
            for r in roots:
                node, depth = B.mixed(r + part.astype(np.uint64) * np.uint64(1 << 40)), 0
                for k, d in enumerate(DEPTHS):
                    for _ in range(d - depth):
                        node = step(node, sig)
                    nodes[k].append(node.view(np.int64))
                    depth = d
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(u, runs)), pa.array(np.tile(part, runs), pa.int32()), pa.array(np.tile(c, runs)), *(pa.array(np.concatenate(x)) for x in nodes)], names=["u", "part", "c", *places])

    left = settle(sets.select("u", "part", "sig", "c").mapInArrow(fall, "u long, part int, c long, " + ", ".join(f"{p} long" for p in places)))
    small: list[DataFrame] = []
    deep: DataFrame | None = None
    stars: DataFrame | None = None
    for k, depth in enumerate(DEPTHS):
        # Nodes of one component have nothing to find.
        counts = left.groupBy(places[k]).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("top"), F.min("u").alias("a")).filter("low < top")
        left = settle(left.join(counts.select(F.col(places[k]).alias("node"), "n", "a"), F.col(places[k]) == F.col("node")).select("node", "u", "part", "c", "n", "a", *places[k + 1 :]))
        small.append(left.filter(F.col("n") <= BRUTE).select("node", F.col("u").alias("u1"), "part", "c"))
        left = left.filter(F.col("n") > BRUTE)
        if k + 1 == len(DEPTHS):
            stars = left.select("a", F.col("u").alias("b")).filter("a <> b").distinct()
            break
        if left.isEmpty():
            break
        if depth >= FIRST:
            now = left.select("node", "u", F.lit(DEPTHS[k + 1]).alias("depth"))
            deep = now if deep is None else deep.union(now)
        left = left.select("u", "part", "c", *places[k + 1 :])
    every = small[0]
    for more in small[1:]:
        every = every.union(more)
    tokens = sets.select("u", F.col("part").alias("part2"), "sig")
    compared = every.join(tokens, (F.col("u1") == F.col("u")) & (F.col("part") == F.col("part2"))).select("node", "u", "c", "sig")
    links = map_groups(compared, ["node"], lambda t: _alike(t, least), "a long, b long")
    return links if stars is None else links.union(stars), deep


def _exact(table: pa.Table, similarity: float) -> pa.RecordBatch:
    """Counts of links (a, a, n) and forests of them (a, b, 0) of each group of one or two blocks."""
    keys = [table.column(c).to_numpy() for c in ("group", "k1", "k2")]
    block, u, n = (table.column(c).to_numpy() for c in ("block", "u", "n"))
    packed = table.column("set").to_pylist()
    change = np.zeros(max(0, len(u) - 1), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(u)]
    rows: list[tuple[int, int, int]] = []
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        if e - s < 2:
            continue
        k1, k2 = int(keys[1][s]), int(keys[2][s])
        order = np.lexsort((u[s:e], block[s:e])) + s
        sets = [np.frombuffer(packed[r], np.uint64) for r in order]
        size = np.array([len(x) for x in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(int(ids.max()) + 1, bool)
        half = int((block[order] == k1).sum())
        links = np.zeros(e - s, np.int64)
        pa_, pb_ = [], []
        for i in range(half):
            low = i + 1 if k1 == k2 else half
            if low >= e - s:
                continue
            mine = ids[at[i] : at[i + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[ids[at[low] :]].astype(np.int32), at[low:-1] - at[low])
            mark[mine] = False
            # inter / (a + b - inter) >= similarity, without a division.
            on = np.flatnonzero(both * (1 + similarity) >= similarity * (size[i] + size[low:]) - 1e-9) + low
            if len(on):
                links[i] += n[order[on]].sum()
                links[on] += n[order[i]]
                pa_.append(np.full(len(on), i))
                pb_.append(on)
        if pa_:
            tree = forest(np.concatenate(pa_), np.concatenate(pb_), e - s)
            rows += [(int(u[order[r]]), int(u[order[r]]), int(links[r])) for r in np.flatnonzero(links)]
            rows += [(int(u[order[p]]), int(u[order[q]]), 0) for p, q in tree]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], names=["a", "b", "links"])


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.99999, seed: int = 0) -> DataFrame:
    """key, class_id (the smallest key that links reach), n_links (other rows linked directly) and kept, of every row."""
    rows = settle(_features(docs, key, text, n))
    reps = settle(rows.filter("u is not null").groupBy("u").agg(F.min(F.struct("key", "sig")).alias("s"), F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).select("u", "rep", "n", F.col("s.sig").alias("sig"), F.col("s.key").alias("holder")))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in B.chunks(batch.column(3), B.PIECE):
                s = Sets(data, offs, n)
                u, low, high = (batch.column(k).slice(i, j - i).to_numpy() for k in range(3))
                at = np.flatnonzero(s.words > 0)
                for part in range(int(low.min()), int(high.max())):
                    on = np.flatnonzero((s.whole == u)[at] & (low[at] <= part) & (part < high[at]))
                    if len(on):
                        sig = s.signatures(part)
                        yield pa.RecordBatch.from_arrays([pa.array(u[at[on]]), pa.array(np.full(len(on), part, np.int32)), pa.array([sig[r].tobytes() for r in on], pa.binary())], names=["u", "part", "sig"])

    def more(wanted: DataFrame) -> DataFrame:
        of = wanted.join(reps.select(F.col("u").alias("u1"), "holder"), F.col("u") == F.col("u1")).drop("u1")
        of = F.broadcast(of) if wanted.count() <= BROADCAST_ROWS else of
        texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(of, F.col("key").eqNullSafe(F.col("holder"))).select("u", "low", "high", "text")
        return texts.mapInArrow(signed, "u long, part int, sig binary").dropDuplicates(["u", "part"])

    rough = components(candidates(reps, similarity, recall, more, seed))
    group = settle(rough.join(reps, F.col("node") == F.col("u")).select(F.col("component").alias("group"), "u", "n", "holder"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in B.chunks(batch.column(3), B.PIECE):
                s = Sets(data, offs, n)
                sets = [np.unique(s.hash[a:b]).tobytes() for a, b in zip(s.at[:-1].tolist(), s.at[1:].tolist(), strict=True)]
                own = pa.array(s.whole == batch.column(1).slice(i, j - i).to_numpy())
                part = pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(sets, pa.binary())], names=["group", "u", "n", "set"])
                yield part.filter(own)

    held = F.broadcast(group) if group.count() <= BROADCAST_ROWS else group
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(held, F.col("key").eqNullSafe(F.col("holder"))).select("group", "u", "n", "text")
    sets = settle(texts.mapInArrow(shingles, "group long, u long, n long, set binary").dropDuplicates(["u"]))
    blocks = sets.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.length("set")) / BLOCK_BYTES)).cast("int").alias("blocks")).withColumnRenamed("group", "group2")
    spread = (
        sets.join(blocks, F.col("group") == F.col("group2"))
        .withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("group", F.least("block", "other").alias("k1"), F.greatest("block", "other").alias("k2"), "block", "u", "n", "set")
    )
    found = settle(map_groups(spread, ["group", "k1", "k2"], lambda t: _exact(t, similarity), "a long, b long, links long").groupBy("a", "b").agg(F.sum("links").alias("links")))
    classes = components(found.filter("a <> b").select("a", "b"))
    counts = found.filter("a = b").select(F.col("a").alias("u3"), "links")
    named = reps.select("u", "rep", "n").join(classes, F.col("u") == F.col("node"), "left").withColumn("c", F.coalesce("component", "u"))
    names = named.groupBy("c").agg(F.min("rep").alias("class_id")).withColumnRenamed("c", "c2")
    per = (
        named.join(names, F.col("c") == F.col("c2"))
        .join(counts, F.col("u") == F.col("u3"), "left")
        .select(F.col("u").alias("__u"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    return rows.select("key", "u").join(per, F.col("u") == F.col("__u"), "left").select(
        F.col("key").alias(key),
        F.when(F.col("u").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("u").isNull().alias("__none"),
    ).withColumn("kept", F.col("__none") | F.col(key).eqNullSafe(F.col("class_id"))).drop("__none")
