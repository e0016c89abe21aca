"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts of up to `order` bytes with the counts of the bytes that follow, learned from the
training rows.  A byte's probability comes from the longest context that has been seen; where the byte is new to it, the
model escapes to the next shorter one (method C: a context with n followers, d of them distinct, escapes with
d / (n + d)), and the followers of the longer context are excluded from the counts of the shorter one.  Below the empty
context all symbols that are not excluded are equally likely.  The log10 probabilities of a text's bytes and of its end
add up to its score.

The trie is one table of the longest grams (a context and its follower) and their counts; every context's shorter ones
are suffixes of it, so all counts come from these.  It is dealt by the two symbols before the follower: a part then
holds every context of two symbols or more that its grams need, and works out their probabilities.  A pair with more
than `HOT` grams is dealt by three symbols, and again by four; such a part gets the followers of its shorter contexts as
rows of their own, as many as there are symbols at most.  Only the counts of pairs of symbols go to all parts; the
alphabet bounds them.  A gram has the same probability wherever it stands, so
texts are taken in batches of about `batch_bytes`, which pass by in chunks: a batch's distinct grams (and words, for the
unigram score) are joined with their values, and come back to the batch.  The model grows with the corpus and is spread
like any table.

Defined results: a null text is scored as an empty one: its end alone; a null key or training flag leaves a row out of
training; without training rows all symbols are equally likely; equal rows are scored alike; other columns, whatever their
names, are not read; an empty table gives an empty result.  Words count as known by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as B
from tidemark.llm.grouped import map_groups
from tidemark.llm.stage import discard, settle

#: Context bytes, bits of a symbol, the symbols of a text's end and of what stands before its begin.
ORDER, BITS, END, PAD = 5, 9, 256, 257
SYMBOLS = 257
BATCH_BYTES, LEAST_BYTES = 48 << 20, 4 << 20
#: Bytes of text whose arrays are in memory at a time.
CHUNK = 1 << 19
#: Stands for the end of a text among the hashes of words.
END_WORD = np.uint64(0x1F3D5B79A2C4E608)
WORD, GRAM = 0, 1
#: Grams of one context of two symbols beyond which they are dealt by three, and by four where these have as many.
HOT = 1 << 20


class Table:
    """A hash table of 64-bit keys, built and read a whole array at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(math.ceil(math.log2(max(1, len(keys)) * 1.5))))
        self.key = np.zeros(1 << self.bits, np.int64)
        self.value = np.zeros(1 << self.bits)
        self.used = np.zeros(1 << self.bits, bool)
        left, owner, n = np.arange(len(keys), dtype=np.int32), np.zeros(1 << self.bits, np.int32), 0
        while len(left):
            s = self.slot(keys[left], n)
            free = ~self.used[s]
            owner[s[free]] = left[free]
            won = free & (owner[s] == left)
            at, who = s[won], left[won]
            self.key[at], self.value[at], self.used[at] = keys[who], values[who], True
            left = left[~won]
            n += 1
        self.rounds = n

    def slot(self, keys: np.ndarray, n: int) -> np.ndarray:
        m = np.uint64((0x9E3779B97F4A7C15 * (2 * n + 1) ** 3 | 1) & 0xFFFFFFFFFFFFFFFF)
        h = keys.view(np.uint64) * m
        return ((h ^ (h >> np.uint64(29))) * m >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(keys), missing)
        left = None
        for n in range(self.rounds):
            k = keys if left is None else keys[left]
            s = self.slot(k, n)
            hit = self.used[s] & (self.key[s] == k)
            if left is None:
                out[hit] = self.value[s[hit]]
                left = np.flatnonzero(~hit & self.used[s])
            else:
                out[left[hit]] = self.value[s[hit]]
                left = left[~hit & self.used[s]]
            if not len(left):
                break
        return out


def grams(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte and end (context and follower, latest symbol lowest), and the first gram of each text."""
    n, docs = len(data), len(offs) - 1
    size = np.diff(offs)
    stream = np.full(n + (order + 1) * docs, PAD, np.int64)
    first = offs[:-1] + np.arange(docs) * (order + 1)
    stream[np.arange(n) + np.repeat((np.arange(docs) + 1) * order + np.arange(docs), size)] = data
    stream[first + order + size] = END
    g = stream[order:].copy()
    for k in range(1, order + 1):
        g |= stream[order - k : len(stream) - k] << (BITS * k)
    # Grams that begin with a text's padding or bytes and end in its bytes or end.
    keep = np.ones(len(g), bool)
    if docs > 1:
        cut = first[1:, None] - order + np.arange(order)
        keep[cut.ravel()] = False
    return g[keep], np.concatenate([[0], np.cumsum(size + 1)])


class Tally:
    """Counts of 64-bit items, merged whenever as much is waiting as is held."""

    def __init__(self):
        self.items, self.n, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, items: np.ndarray, counted: np.ndarray) -> None:
        """Counts the items that are `counted`; the others are only listed."""
        u, n = np.unique(items[counted], return_counts=True)
        rest = np.unique(items[~counted])
        self.waiting += [(u, n), (rest, np.zeros(len(rest), np.int64))]
        self.size += len(u) + len(rest)
        if self.size > max(1 << 20, len(self.items)):
            self.merge()

    def merge(self) -> None:
        parts = [(self.items, self.n), *self.waiting]
        items, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self.waiting, self.size = [], 0
        if len(items):
            by = np.argsort(items, kind="stable")
            items = items[by]
            first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
            self.items, self.n = items[first], np.add.reduceat(n[by], first)


def _segments(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one batch of texts each, in order; `batch` is the first column."""
    for r in rows:
        batch = r.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(batch[1:] != batch[:-1]) + 1).tolist(), len(batch)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e > s:
                yield int(batch[s]), r.slice(s, e - s)


def _items(order: int):
    """batch, kind, item and training count of the distinct words and grams of each batch; texts pass by in chunks."""

    def flushed(batch: int, seen: dict[int, Tally]) -> Iterator[pa.RecordBatch]:
        for kind, tally in seen.items():
            tally.merge()
            for i in range(0, len(tally.items), 1 << 16):
                item, n = tally.items[i : i + (1 << 16)], tally.n[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), batch)), pa.array(np.full(len(item), kind, np.int32)), pa.array(item), pa.array(n)], names=["batch", "kind", "item", "n"])

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, {}
        for batch, r in _segments(rows):
            if batch != current:
                yield from flushed(current, seen)
                current, seen = batch, {WORD: Tally(), GRAM: Tally()}
            train = r.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, offs in B.chunks(r.column(1), CHUNK):
                use, w = train[i:j], B.Words(data, offs)
                seen[WORD].add(np.concatenate([w.hashes(), np.full(j - i, END_WORD)]).view(np.int64), np.concatenate([use[w.doc], use]))
                g, at = grams(data, offs, order)
                seen[GRAM].add(g, np.repeat(use, np.diff(at)))
        yield from flushed(current, seen)
        pa.default_memory_pool().release_unused()

    return each


def _followers(item: np.ndarray, n: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, in order, and of each all that followed, the different followers, and what followed its shorter context of these."""
    u, at = np.unique(item, return_index=True)
    new = np.flatnonzero(np.concatenate([[True], (u[1:] >> BITS) != (u[:-1] >> BITS)]))
    nu = n[at]
    return (u[new] >> BITS, *(np.add.reduceat(x.astype(np.int64), new) for x in (nu, nu > 0, np.where(nu > 0, shorter[at], 0))))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key in sorted keys; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _context_values(order: int, pairs: np.ndarray):
    """item and value from tables of whole groups of the grams (level, context, k, item, n) whose contexts share their `level` latest symbols.

    Such a group holds every context of `level` symbols or more that its grams (k is 0) look up.  The followers of its
    shorter contexts of k symbols, from two on, come with it as rows of their own; `pairs` has the counts of followers by
    the symbol before them.
    """
    single = pairs.sum(0)
    short = [
        (np.array([single.sum()]), np.array([(single > 0).sum()]), np.zeros(1, np.int64)),
        (pairs.sum(1), (pairs > 0).sum(1), np.where(pairs > 0, single, 0).sum(1)),
    ]
    low = lambda item, k: item & ((1 << BITS * k) - 1)

    def each(table: pa.Table) -> pa.RecordBatch:
        level, kind, item, n = (table.column(c).to_numpy() for c in ("level", "k", "item", "n"))
        given = {k: np.unique(np.stack([item[kind == k], n[kind == k]], 1), axis=0) for k in range(2, int(level.max(initial=2)))}
        level, item, n = level[kind == 0], item[kind == 0], n[kind == 0]
        last, before = low(item, 1), low(item >> BITS, 1)
        counts = [single[last], pairs[before, last]]
        found = []
        for k in range(2, order + 1):
            gram = low(item, k + 1)
            u, at, inv = np.unique(gram, return_index=True, return_inverse=True)
            nu = np.bincount(inv, n, len(u)).astype(np.int64)
            context, *sums = _followers(u, nu, counts[k - 1][at])
            mine, triple = nu[inv], [_lookup(context, x, gram >> BITS) for x in sums]
            if (far := level > k).any():
                held, of = given[k][:, 0], given[k][:, 1]
                shorter = pairs[low(held >> BITS, 1), low(held, 1)] if k == 2 else _lookup(*given[k - 1].T, low(held, k))
                mine[far] = _lookup(held, of, gram[far])
                context, *sums = _followers(held, of, shorter) if len(held) else (held, of, of, of)
                for x, y in zip(triple, sums, strict=True):
                    x[far] = _lookup(context, y, gram[far] >> BITS)
            counts.append(mine)
            found.append(triple)
        value, open_ = np.zeros(len(item)), np.ones(len(item), bool)
        ex_n, ex_d = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        for k in range(order, -1, -1):
            total, distinct, below = found[k - 2] if k > 1 else (x[before if k else np.zeros(len(item), np.int64)] for x in short[k])
            new = distinct - ex_d
            on = open_ & (total > 0) & (new > 0)
            share = np.where(counts[k] > 0, counts[k], new)[on] / (total - ex_n + new)[on]
            value[on] += np.log10(share)
            open_ &= counts[k] == 0
            ex_n, ex_d = np.where(total > 0, below, ex_n), np.where(total > 0, distinct, ex_d)
        value[open_] -= np.log10(SYMBOLS - ex_d[open_])
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(value)], names=["item", "value"])

    return each


def gram_scores(counts: DataFrame, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """item and value: the log10 probability of each gram's last symbol after its context.

    `counts` has every gram that is asked for once, with its training count, which may be 0.
    """
    low = lambda k: F.lit((1 << BITS * k) - 1)
    context = lambda k: F.shiftright("item", BITS).bitwiseAND(low(k))
    pairs = np.zeros((1 << BITS, 1 << BITS), np.int64)
    # At most one row for each two symbols.
    ends = counts.groupBy(context(1).alias("a"), F.col("item").bitwiseAND(low(1)).alias("b")).agg(F.sum("n").alias("n"))
    for r in ends.filter("n > 0").collect():
        pairs[r.a, r.b] = r.n
    dealt = counts.select(F.lit(2).alias("level"), context(2).alias("context"), F.lit(0).alias("k"), "item", "n")
    extra: list[tuple[int, DataFrame]] = []
    for k in range(2, min(4, order)):
        # Contexts with more than `hot` grams: their number is at most that of all grams over `hot`.
        sizes = dealt.filter(F.col("level") == k).groupBy(F.col("context").alias("of")).agg(F.count(F.lit(1)).alias("grams"))
        big = settle(sizes.filter(F.col("grams") > hot).select("of"))
        if big.isEmpty():
            break
        crowded = dealt.filter(F.col("level") == k).join(F.broadcast(big), F.col("context") == F.col("of")).drop("of")
        extra.append((k, settle(crowded.groupBy(F.col("item").bitwiseAND(low(k + 1)).alias("gram")).agg(F.sum("n").alias("m")).filter("m > 0"))))
        split = F.col("of").isNotNull()
        moved = dealt.join(F.broadcast(big), (F.col("level") == k) & (F.col("context") == F.col("of")), "left")
        dealt = moved.select(F.when(split, k + 1).otherwise(F.col("level")).alias("level"), F.when(split, context(k + 1)).otherwise(F.col("context")).alias("context"), "k", "item", "n")
    rows = dealt
    groups = dealt.filter("level > 2").select("level", "context").distinct() if extra else None
    for k, given in extra:
        # A context of k symbols has as many rows as there are symbols at most, for each group that extends it.
        of = groups.filter(F.col("level") > k).join(given, F.col("context").bitwiseAND(low(k)) == F.shiftright("gram", BITS))
        rows = rows.union(of.select("level", "context", F.lit(k), "gram", "m"))
    return map_groups(rows, ["level", "context"], _context_values(order, pairs), "item long, value double")


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score and score of every row."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    # Texts are long: small Arrow batches keep the buffers of both sides small.
    conf.set(name, "1000")
    try:
        # The scores are written while the setting holds.
        return settle(_score(docs, train, key, text, order, batch_bytes))
    finally:
        conf.set(name, before)


def _score(docs: DataFrame, train: Column, key: str, text: str, order: int, batch_bytes: int) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # Large batches share more grams; every core has a batch unless those get too small.
    cores = docs.sparkSession.sparkContext.defaultParallelism
    batches = max(1, min(math.ceil(size / LEAST_BYTES), max(math.ceil(size / batch_bytes), cores)))
    kind = docs.schema[key].dataType.simpleString()
    work = docs.select(
        F.pmod(F.xxhash64(key, text), F.lit(batches)).alias("batch"),
        F.col(key).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    whole = work.select("batch", "text", "train").repartition("batch").sortWithinPartitions("batch")
    items = settle(whole.mapInArrow(_items(order), "batch long, kind int, item long, n long"), packed=True)
    counts = settle(items.groupBy("kind", "item").agg(F.sum("n").alias("n")), packed=True)
    known_words = (F.col("kind") == WORD) & (F.col("n") > 0)
    total = counts.filter(known_words).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, distinct = int(total[0]), int(total[1])
    words = counts.filter(known_words).select("item", F.col("n").cast("double").alias("value"))
    values = gram_scores(counts.filter(F.col("kind") == GRAM).select("item", "n"), order)
    named = settle(words.withColumn("kind", F.lit(WORD)).union(values.withColumn("kind", F.lit(GRAM))), packed=True)
    discard(counts)
    named = named.select(F.col("kind").alias("k2"), F.col("item").alias("i2"), "value")
    known = items.join(named, (F.col("kind") == F.col("k2")) & (F.col("item") == F.col("i2")))
    nothing = F.lit(None)
    stream = known.select("batch", "kind", "item", "value", nothing.cast(kind).alias("key"), nothing.cast("string").alias("text"), nothing.cast("boolean").alias("train")).union(
        work.select("batch", F.lit(2).alias("kind"), nothing.cast("long"), nothing.cast("double"), "key", "text", "train")
    )

    def rate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, tables = None, {}, {}
        for batch, r in _segments(rows):
            if batch != current:
                tables.clear()
                current, parts = batch, {WORD: [], GRAM: []}
            what = r.column(1).to_numpy()
            cuts = np.searchsorted(what, [WORD, GRAM, 2, 3])
            for k in (WORD, GRAM):
                if cuts[k + 1] > cuts[k]:
                    # Copies: a slice would keep all columns of its Arrow batch.
                    parts[k].append([r.column(c).slice(cuts[k], cuts[k + 1] - cuts[k]).to_numpy(zero_copy_only=False).copy() for c in (2, 3)])
            asked = r.slice(cuts[2])
            if not asked.num_rows:
                continue
            if not tables:
                # Texts come after all of their batch's words and grams.
                for k in (WORD, GRAM):
                    held = parts.pop(k)
                    items, values = (np.concatenate([np.zeros(0, t), *(p[i] for p in held)]) for i, t in ((0, np.int64), (1, np.float64)))
                    held.clear()
                    tables[k] = Table(items, values)
                    del items, values
            out = []
            end_n = tables[WORD].get(np.array([END_WORD]).view(np.int64), 0.0)[0]
            for _, _, data, offs in B.chunks(asked.column(5), CHUNK):
                w = B.Words(data, offs)
                n = tables[WORD].get(w.hashes().view(np.int64), 0.0)
                sums = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
                each = lambda x: np.log10((x + 1) / (tokens + distinct + 1))
                g, at = grams(data, offs, order)
                value = np.add.reduceat(tables[GRAM].get(g, math.nan), at[:-1])
                out.append((w.count + 1, sums(n > 0, w.at) + (end_n > 0), sums(each(n), w.at) + each(end_n), value))
            counted = [np.concatenate(c) for c in zip(*out, strict=True)]
            types = (np.int64, np.int64, np.float64, np.float64)
            yield pa.RecordBatch.from_arrays(
                [asked.column(4), asked.column(6), *(pa.array(x.astype(t)) for x, t in zip(counted, types, strict=True))],
                names=["key", "train", "n_tokens", "n_known", "base_score", "score"],
            )
        pa.default_memory_pool().release_unused()

    scored = (
        stream.repartition("batch").sortWithinPartitions("batch", "kind")
        .mapInArrow(rate, f"key {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    )
    return scored.select(F.col("key").alias(key), "train", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")

