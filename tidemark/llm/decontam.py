"""Benchmark decontamination: n-gram windows of test items, found in documents, verified and removed.

The windows of the items are hashed into a set that goes to the executors; documents' windows are looked up in it, and
each hit is compared by its bytes.  A window is held once, however many items have it, with the number of its list of
items; windows of a passage that many items share have the same list, so a hit costs the same as one of a single item.

A benchmark of at most `block_bytes` of UTF-8 text is one such set, and documents pass through one scan, without a shuffle.
A larger one is taken in blocks of that size (or one item): each is broadcast, looked up in all documents, what is found is
written as a table, and the block goes before the next is made.  So what is broadcast at once and held by a worker is
bounded however large the benchmark is; the tables are joined to the documents by their texts' hashes.

Words are runs of digits, lower-cased letters and characters above ASCII.  A window is n words; an item of fewer words
(but not none) is one window.

Defined results: a null text has no words; an empty table or benchmark gives no hits; item ids are text, and items that
share an id count as one; repeated rows are scanned alike; other columns are kept, but the ones added replace columns of
the same name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes as B
from tidemark.llm.stage import settle

BLOCK_BYTES = 16 << 20


class Block:
    """The windows of some items as arrays: by length, sorted hashes, and the place and the list of items of each.

    `text` has the items' words, lower-cased and parted by single spaces, so a window is a slice of it.  A window takes 20
    bytes (more while they are made), so a block of n bytes of text, with a window for each four bytes at most, takes
    about 6 n.
    """

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.names = np.array(sorted({i for i, _ in items}), object)
        number = {i: k for k, i in enumerate(self.names)}
        texts, found, base = [], defaultdict(list), 0
        for i, j, data, offs in B.chunks(pa.array([t for _, t in items], pa.large_string()), 1 << 20) if items else ():
            w = B.Words(data, offs, B.ALNUM)
            if not len(w.begin):
                continue
            spaced, begin = w.spaced()
            size_of, words = np.minimum(w.count, n), w.hashes()
            for size in np.unique(size_of[size_of > 0]).tolist():
                first, h = B.windows(words, w.doc, size)
                _, h2 = B.windows(B.mixed(words + np.uint64(size)), w.doc, size)
                mine = size_of[w.doc[first]] == size
                first, h, h2 = first[mine], h[mine], h2[mine]
                who = np.array([number[items[i + d][0]] for d in range(j - i)], np.uint32)[w.doc[first]]
                found[size].append((h, h2, who, (base + begin[first]).astype(np.uint32)))
            texts.append(spaced)
            base += len(spaced)
        self.text = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.seen: dict[int, np.ndarray] = {}
        self.lists: list[np.ndarray] = []
        known: dict[tuple, int] = {}
        for size, parts in found.items():
            h, h2, who, at = (np.concatenate([p[k] for p in parts]) for k in range(4))
            parts.clear()
            order = np.lexsort((who, h2, h))
            h, h2, who, at = h[order], h2[order], who[order], at[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            once = new.copy()
            once[1:] |= who[1:] != who[:-1]
            start = np.flatnonzero(new[once])
            own = who[once]
            # Lists are told apart by their length and two sums over hashes of their items.
            marks = B.mixed(own.astype(np.uint64) + np.uint64(1))
            sums = np.add.reduceat(marks, start), np.add.reduceat(B.mixed(marks), start), np.diff(np.append(start, len(own)))
            of = np.empty(len(start), np.int32)
            for k, key in enumerate(zip(*(x.tolist() for x in sums), strict=True)):
                if key not in known:
                    known[key] = len(self.lists)
                    self.lists.append(own[start[k] : start[k] + key[2]].copy())
                of[k] = known[key]
            self.windows[size] = h[new], at[new], of
            self.seen[size] = np.zeros(1 << 20, bool)
            self.seen[size][(h >> np.uint64(44)).astype(np.int64)] = True

    def scan(self, w: B.Words) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
        """By row: windows that occur (first word, word after the last; of the row), and the lists of their items."""
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        lists: dict[int, set[int]] = defaultdict(set)
        if not self.windows or not len(w.begin):
            return spans, lists
        h = w.hashes()
        spaced, begin = w.spaced()
        end = begin + w.end - w.begin
        for size, (table, at, of) in self.windows.items():
            first, got = B.windows(h, w.doc, size)
            maybe = self.seen[size][(got >> np.uint64(44)).astype(np.int64)]
            first, got = first[maybe], got[maybe]
            low, high = np.searchsorted(table, got, "left"), np.searchsorted(table, got, "right")
            on = np.flatnonzero(high > low)
            for x, lo, hi in zip(first[on].tolist(), low[on].tolist(), high[on].tolist(), strict=True):
                text = spaced[begin[x] : end[x + size - 1]]
                for k in range(lo, hi):
                    stop = int(at[k]) + len(text)
                    if np.array_equal(self.text[at[k] : stop], text) and (stop == len(self.text) or self.text[stop] == 32):
                        d = int(w.doc[x])
                        x0 = x - int(w.at[d])
                        spans[d].append((x0, x0 + size))
                        lists[d].add(int(of[k]))
        return spans, lists

    def items(self, lists: set[int]) -> list[str]:
        """The ids in some lists, sorted as text."""
        return self.names[np.unique(np.concatenate([self.lists[k] for k in lists]))].tolist()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))


def item_blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, str]]]:
    rows: list[tuple[str, str]] = []
    size = 0
    for r in benchmark.select(F.col(item).cast("string"), F.col(text), F.octet_length(text)).filter(F.col(text).isNotNull()).toLocalIterator():
        if rows and size + r[2] > most:
            yield rows
            rows, size = [], 0
        rows.append((r[0] or "", r[1]))
        size += r[2]
    if rows:
        yield rows


_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _scan(block: Block | None, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text: number of words, merged spans and items."""
    counts, spans, items = np.zeros(len(column), np.int64), [[] for _ in range(len(column))], [[] for _ in range(len(column))]
    for i, j, data, offs in B.chunks(column, B.PIECE):
        w = B.Words(data, offs, B.ALNUM)
        counts[i:j] = w.count
        found, lists = block.scan(w) if block is not None else ({}, {})
        for d, s in found.items():
            spans[i + d], items[i + d] = merged(s), block.items(lists[d])
    return counts, spans, items


def _as_spans(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"from": x, "to": y} for x, y in s] for s in spans], _SPANS)


def _by_blocks(docs: DataFrame, blocks: Iterator[list[tuple[str, str]]], text: str, n: int) -> DataFrame:
    """h1 and h2 (hashes of a text), and spans and items of all blocks, of the texts in which anything is found."""
    tables = []
    texts = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h1"), F.md5(text).alias("h2"), F.col(text).alias("text"))
    for rows in blocks:
        block = docs.sparkSession.sparkContext.broadcast(Block(rows, n))

        def look(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, spans, items = _scan(block.value, batch.column(2))
                on = pa.array([k for k, s in enumerate(spans) if s], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(on), batch.column(1).take(on), _as_spans(spans).take(on), pa.array(items, pa.list_(pa.string())).take(on)], names=["h1", "h2", "spans", "items"])

        schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.StringType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
        tables.append(settle(texts.mapInArrow(look, schema).dropDuplicates(["h1", "h2"])))
        block.destroy()
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    # A text has a row a block at most.
    return every.groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 13, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """Adds n_words, hits (merged spans of words inside occurring windows) and items (ids, sorted as text).

    With `cut`, texts lose the hit spans (from the first byte of a span's first word to the last of its last word).
    """
    df = docs.drop("n_words", "hits", "items")
    names = df.columns
    schema = df.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast(SPANS), "items": F.array().cast("array<string>")}).schema
    blocks = item_blocks(benchmark, item, item_text, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        whole, given = docs.sparkSession.sparkContext.broadcast(Block(first, n)), df
    else:
        whole = None
        found = _by_blocks(df, chain((first, second), blocks), text, n)
        found = found.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("spans").alias("__spans"), F.col("items").alias("__items"))
        given = df.join(found, (F.xxhash64(text) == F.col("__h1")) & (F.md5(text) == F.col("__h2")), "left").select(*names, "__spans", "__items")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What goes back at once is a piece, not a whole batch of texts.
        for batch in chain.from_iterable(B.slices(b, names.index(text)) for b in batches):
            counts, spans, items = _scan(whole.value if whole is not None else None, batch.column(names.index(text)))
            if whole is None:
                spans = [merged([(x["from"], x["to"]) for x in s or ()]) for s in batch.column(len(names)).to_pylist()]
                items = [sorted(x or ()) for x in batch.column(len(names) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts), _as_spans(spans), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "hits", "items"])

    df = given.mapInArrow(scan, schema)
    return df.mapInArrow(lambda it: map(lambda b: cut_spans(b, text), it), schema) if cut else df


def cut_spans(batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    k, hits = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index("hits")).to_pylist()
    texts = batch.column(k).to_pylist()
    for r, spans in enumerate(hits):
        if spans:
            raw = np.frombuffer(texts[r].encode(), np.uint8)
            w = B.Words(raw, np.array([0, len(raw)]), B.ALNUM)
            left, at = [], 0
            for s in spans:
                left.append(raw[at : w.begin[s["from"]]].tobytes())
                at = int(w.end[s["to"] - 1])
            texts[r] = b"".join([*left, raw[at:].tobytes()]).decode()
    columns = list(batch.columns)
    columns[k] = pa.array(texts, batch.schema.field(k).type)
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def hit_words() -> Column:
    """Words inside occurring windows."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])


def contaminated(share: int = 20) -> Column:
    """At least one word in `share` is hit."""
    return (hit_words() > 0) & (share * hit_words() >= F.col("n_words"))


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, as they are."""
    return find(docs, benchmark, text, **options).filter(~contaminated()).select(*docs.columns)
