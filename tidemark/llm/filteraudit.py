"""Filter interaction audit over sorted posting lists.

Each filter has, for every part and range of ids, the sorted list of the documents that fail it.  What a filter removes
after others is its list less the union of theirs; all such unions and differences are merges of sorted lists, in which
the shorter list gallops through the longer one.  Only sizes leave a range of ids, and sizes add up.

The filters of a document's text (words are maximal runs of `[^\\x20\\x09-\\x0D]`):

A  fewer than 100 words                   B  100 * distinct words < 80 * words
C  100 * A-Z > 10 * code points           D  holds any of # $ % & * |
E  is identical to the text of a smaller id, anywhere in the table

E's list is all ids less the first id of each text, so copies of a text meet in a partial minimum alone and are never
joined.  Ids go to ranges of `2 ** RANGE`, and rows that are alike in id, part, text and failures are counted first.

Defined results: a null text is empty (it fails A only, and E if an empty text has a smaller id); a null part is the empty
string; a null id is a document of its own that is no smaller and no greater than any other and has no label; rows that
share an id are documents each, and none is a copy of the other; several labels of one id count as the greatest; other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textbytes as B
from tidemark.llm.grouped import map_groups
from tidemark.llm.stage import settle

LETTERS = "ABCDE"
#: log2 of the ids of a range.
RANGE = 8
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in "#$%&*|"]] = True


def failures(docs: DataFrame, text: str, part: str) -> DataFrame:
    """doc_id, part, h1 and h2 (128 bits of hash of the text) and mask (bit k: fails LETTERS[k]; not E) of each document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in B.chunks(batch.column(3)):
                rows = j - i
                w = B.Words(data, offs, B.SOLID, lower=False)
                words = w.count
                h = w.hashes()
                order = np.lexsort((h, w.doc))
                h, doc = h[order], w.doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                distinct = np.bincount(doc[new], minlength=rows)
                whole = w.hash_of(offs[:-1], offs[1:]).view(np.int64)

                def count(on: np.ndarray, offs: np.ndarray = offs) -> np.ndarray:
                    total = np.zeros(len(on) + 1, np.int64)
                    np.cumsum(on, out=total[1:])
                    return total[offs[1:]] - total[offs[:-1]]

                points, capitals, marks = count((data & 0xC0) != 0x80), count((data >= 65) & (data <= 90)), count(MARKS[data])
                mask = (words < 100) + 2 * (100 * distinct < 80 * words) + 4 * (100 * capitals > 10 * points) + 8 * (marks > 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, rows) for k in range(3)), pa.array(whole), pa.array(mask.astype(np.int32))], names=["doc_id", "part", "h1", "h2", "mask"])

    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(whole).alias("h1"), whole.alias("text")).mapInArrow(
        emit, "doc_id long, part string, h1 long, h2 long, mask int"
    )


def _place(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each id of `short` is, or would be, in `long`, and which are there."""
    at = np.searchsorted(long, short)
    there = np.zeros(len(short), bool)
    inside = at < len(long)
    there[inside] = long[at[inside]] == short[inside]
    return at, there


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of either sorted list."""
    if len(a) < len(b):
        a, b = b, a
    at, there = _place(b, a)
    return np.insert(a, at[~there], b[~there])


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of a sorted list that another lacks."""
    if len(a) <= len(b):
        return a[~_place(a, b)[1]]
    at, there = _place(b, a)
    return np.delete(a, at[there])


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of both sorted lists."""
    if len(a) > len(b):
        a, b = b, a
    return a[_place(a, b)[1]]


def _range_sizes(table: pa.Table) -> pa.RecordBatch:
    """Of each part of some ranges: for every filter and set of earlier filters, how many documents it removes, and how many of them are good and toxic."""
    kind, mask, n, good, toxic = (table.column(c).to_numpy() for c in ("kind", "mask", "n", "good", "toxic"))
    known = ~table.column("doc_id").is_null().to_numpy()
    doc = table.column("doc_id").fill_null(0).to_numpy()
    h1, h2 = table.column("h1").fill_null(0).to_numpy(), table.column("h2").fill_null(0).to_numpy()
    # The first id of each text, found by (id, text).
    rows, firsts = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    both = np.concatenate([firsts, rows[known[rows]]])
    order = np.lexsort((-kind[both], h2[both], h1[both], doc[both]))
    s = both[order]
    new = np.ones(len(s), bool)
    new[1:] = (doc[s][1:] != doc[s][:-1]) | (h1[s][1:] != h1[s][:-1]) | (h2[s][1:] != h2[s][:-1])
    leads = (kind[s] == 1)[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))] if len(s) else np.zeros(0, bool)
    copy = np.zeros(len(kind), bool)
    copy[s[~leads]] = True
    marked = {}
    for name, flag in (("good", good), ("toxic", toxic)):
        ids = np.unique(doc[(kind == 2) & (flag > 0)])
        marked[name] = _place(doc, ids)[1] & known
    # Lists hold places in the order of ids, so rows that share an id stay apart.
    out = []
    parts = table.column("part").combine_chunks().dictionary_encode()
    code = parts.indices.fill_null(-1).to_numpy()
    for p, name in enumerate(parts.dictionary.to_pylist()):
        own = rows[code[rows] == p]
        if not len(own):
            continue
        fails = [own[(mask[own] >> k & 1).astype(bool)] for k in range(4)] + [own[copy[own]]]
        better, worse = own[marked["good"][own]], own[marked["toxic"][own]]
        size = len if (n[own] == 1).all() else (lambda x: int(n[x].sum()))
        joined = [own[:0]]
        for before in range(1, 32):
            low = (before & -before).bit_length() - 1
            joined.append(union(joined[before & (before - 1)], fails[low]))
        total = size(own)
        for k in range(5):
            for before in range(32):
                if not before >> k & 1:
                    gone = minus(fails[k], joined[before])
                    out.append((name, k, before, total, size(gone), size(common(gone, better)), size(common(gone, worse))))
    columns = zip(*out, strict=True) if out else [()] * 7
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "filter", "before", "total", "removed", "good_lost", "toxic_lost"])


def sizes(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter, before (set of earlier filters, as bits), total, removed, good_lost, toxic_lost, fails, unique_fails, shapley."""
    feats = settle(failures(docs, text, part).groupBy("doc_id", "part", "h1", "h2", "mask").agg(F.count(F.lit(1)).alias("n")))
    nothing = lambda *kinds: [F.lit(None).cast(k).alias(c) for c, k in kinds]
    zero = [F.lit(0).cast("long").alias(c) for c in ("good", "toxic")]
    rows = feats.select(F.lit(0).alias("kind"), "doc_id", "part", "h1", "h2", "mask", "n", *zero)
    first = feats.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    first = first.select(F.lit(1).alias("kind"), "doc_id", *nothing(("part", "string")), "h1", "h2", F.lit(0).alias("mask"), F.lit(0).cast("long").alias("n"), *zero)
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0).cast("long"))).alias(c)
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    marks = marks.select(F.lit(2).alias("kind"), "doc_id", *nothing(("part", "string"), ("h1", "long"), ("h2", "long")), F.lit(0).alias("mask"), F.lit(0).cast("long").alias("n"), F.col("quality").alias("good"), "toxic")
    # Ids that are null have no copies and no labels, so any range does for them.
    at: Column = F.coalesce(F.shiftright("doc_id", RANGE), F.shiftright("h1", RANGE))
    lists = rows.unionByName(first).unionByName(marks).select(at.alias("range"), "doc_id", "kind", "part", "h1", "h2", "mask", "n", "good", "toxic")
    found = map_groups(lists, ["range", "doc_id"], _range_sizes, "part string, filter int, before int, total long, removed long, good_lost long, toxic_lost long", within="range")
    summed = found.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in ("total", "removed", "good_lost", "toxic_lost")))
    alone = Window.partitionBy("part", "filter")
    orders = F.bit_count("before")
    times = sum((F.when(orders == k, factorial(k) * factorial(4 - k)).otherwise(0) for k in range(5)), F.lit(0)).cast("long")
    return summed.select(
        "*",
        F.max(F.when(F.col("before") == 0, F.col("removed"))).over(alone).alias("fails"),
        F.max(F.when(orders == 4, F.col("removed"))).over(alone).alias("unique_fails"),
        F.sum(F.col("removed") * times).over(alone).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step."""
    steps = [("".join(o), s + 1, LETTERS.index(o[s]), sum(1 << LETTERS.index(x) for x in o[:s])) for o in permutations(LETTERS) for s in range(5)]
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, b int")
    rows = sizes(docs, labels, text, part).join(F.broadcast(orders), (F.col("filter") == F.col("f")) & (F.col("before") == F.col("b")))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("removed").over(so_far)).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        "shapley",
    )
