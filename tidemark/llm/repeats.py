"""Suffix-array dedup: repeated byte strings found by distributed prefix doubling, and removed from all documents but the first.

Each byte that lies in a string of `n` bytes that also starts in a document with a smaller id goes.

Ranks of the strings of 16 bytes are doubled to 32 and to `n`, and a position leaves as soon as its rank is its document's
own.  As most positions would leave in the first round, it is run on anchors that stand for them: every position's string
of n bytes holds n - 15 strings of 16 bytes, and the one with the smallest hash is its anchor.  Equal strings have equal
anchors, whatever stands around them, so a string whose anchor occurs in one document alone is unique.

1. Spark sorts anchors by rank.  The positions in a row that share an anchor make a unit of at most n - 15 strings.  Where an
   anchor has one document, its units leave.  Where a unit (all its bytes) is in several, all but the first lose it whole.
2. What is left are first occurrences of units whose anchor also occurs in other units.  Their strings are dealt by the rank
   of 32 bytes at the anchor's side that they all hold, doubled from the anchor's own: those that start up to 16 bytes
   before the anchor by the bytes from there on, the rest by the anchor's bytes and the 16 behind it.  Ranks that one
   document has leave.  What goes with a rank is only what its strings hold besides these 32 bytes.
3. Strings of n bytes under a rank are sorted; those whose first document is another one go.  An anchor that stands out, with
   a `SHARE` of all units that are left or more than `MOST`, sends its strings one by one instead, to be combined before the
   shuffle; so no task holds a hot anchor's units, and none holds more than `MOST` of one anchor.

Texts are read three times and travel twice, to meet what was found in them; no rank is collected.

Defined results: a null text is empty; strings never cross documents, a document's own repeats stay, and so do equal texts
that share an id; a null id is neither smaller nor greater than any other, so nothing is removed from it or for its sake;
texts of under n bytes stay; what is left of a text is bytes, as a cut may fall into a character; other columns are kept,
but those that are added replace columns of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textbytes as B
from tidemark.llm.grouped import map_groups
from tidemark.llm.stage import discard, settle

#: Bytes of an anchor.
GRAM = 16
#: An anchor with more units than this share of all, or than MOST, has its strings sorted one by one; one with up to LEAST never.
SHARE, LEAST, MOST = 1 / 1024, 2048, 1 << 17
_C = np.uint64(0x9FB21C651E98DF25)
_D = np.uint64(0xD6E8FEB86659FD93)


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as numbers."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def gram_ranks(data: np.ndarray) -> np.ndarray:
    """A 64-bit rank of the 16 bytes from each position on: two ranks of 8 bytes, paired."""
    e = _eights(data)
    if len(e) <= 8:
        return np.zeros(0, np.uint64)
    a, b = e[:-8] * _C, e[8:] * _D
    a ^= a >> np.uint64(32)
    a += b ^ (b >> np.uint64(29))
    return B.mixed(a)


class Units:
    """Units of a chunk: doc (row), begin and end (places of its first and last string), rank (its anchor's) and whole (hash of all bytes).

    A string's anchor is the leftmost of its 16 bytes with the smallest rank; strings that share its place are a unit.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, n: int):
        self.data, self.offs, self.n = data, offs, n
        spots = len(data) - n + 1
        if spots <= 0:
            self.doc = self.begin = self.end = np.zeros(0, np.int64)
            self.rank = self.whole = np.zeros(0, np.int64)
            return
        grams = low = gram_ranks(data)
        width, most = 1, n - GRAM + 1
        while width * 2 <= most:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if most > width:
            low = np.minimum(low[: width - most], low[most - width :])
        # Positions whose string lies in one text.
        inside = np.zeros(spots + 1, np.int8)
        size = np.diff(offs)
        long = size >= n
        np.add.at(inside, offs[:-1][long], 1)
        np.add.at(inside, offs[1:][long] - n + 1, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        new = inside.copy()
        new[1:] &= (low[1:] != low[:-1]) | (grams[: spots - 1] == low[:-1]) | ~inside[:-1]
        last = inside.copy()
        last[:-1] &= new[1:] | ~inside[1:]
        begin, self.end = np.flatnonzero(new), np.flatnonzero(last)
        self.begin, self.grams = begin, grams
        self.doc = np.searchsorted(offs, begin, "right") - 1
        self.rank = low[begin].view(np.int64)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * B.powers(B._R, len(data)), out=self._sums[1:])
        self.whole = (self.hashes(begin, self.end + n) ^ ((self.end - begin).astype(np.uint64) * _D)).view(np.int64)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return B.mixed((self._sums[end] - self._sums[begin]) * B.powers(B._RI, len(self.data) + 1)[begin])

    def anchors(self, at: np.ndarray) -> np.ndarray:
        """The place of the anchor of some units."""
        place = np.full(len(at), -1, np.int64)
        left = np.arange(len(at))
        for k in range(self.n - GRAM + 1):
            p = self.end[at[left]] + k
            on = self.grams[p].view(np.int64) == self.rank[at[left]]
            place[left[on]] = p[on]
            left = left[~on]
            if not len(left):
                break
        return place


def _units(docs: DataFrame, n: int) -> DataFrame:
    """rank, whole, doc (the least document) and docs (all, where a batch has several) of units, once for each batch."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, data, offs in B.chunks(batch.column(1), 2 << 20):
                u = Units(data, offs, n)
                if not len(u.begin):
                    continue
                doc = ids[i + u.doc]
                order = np.lexsort((doc, u.whole, u.rank))
                rank, whole, doc = u.rank[order], u.whole[order], doc[order]
                new = np.ones(len(order), bool)
                new[1:] = (rank[1:] != rank[:-1]) | (whole[1:] != whole[:-1])
                once = new.copy()
                once[1:] |= doc[1:] != doc[:-1]
                doc, start = doc[once], np.flatnonzero(new[once])
                count = np.diff(np.append(start, len(doc)))
                several = count > 1
                # Lists of single documents are null.
                ends = np.concatenate([[0], np.cumsum(np.where(several, count, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~several, False)), pa.array(doc[np.repeat(several, count)]))
                yield pa.RecordBatch.from_arrays([pa.array(rank[new]), pa.array(whole[new]), pa.array(doc[start]), lists], names=["rank", "whole", "doc", "docs"])

    return docs.mapInArrow(emit, "rank long, whole long, doc long, docs array<long>")


#: What is known of a unit of a document: all of it goes; it is a first occurrence whose strings others may have.
GONE, FIRST = 0, 1


def _shared(units: DataFrame) -> DataFrame:
    """doc, whole, kind, ask (whether an earlier document has the anchor) and size (units of the anchor), of units whose anchor several documents have."""
    dealt = units.repartition("rank")
    anchor, unit = Window.partitionBy("rank"), Window.partitionBy("rank", "whole")
    last = F.when(F.col("docs").isNull(), F.col("doc")).otherwise(F.element_at("docs", -1))
    seen = dealt.withColumn("first", F.min("doc").over(unit)).select(
        "*",
        F.min("doc").over(anchor).alias("low"),
        F.max(last).over(anchor).alias("high"),
        (F.min("whole").over(anchor) < F.max("whole").over(anchor)).alias("mixed"),
        F.count(F.lit(1)).over(anchor).alias("size"),
    ).filter("low < high")
    each = seen.select("whole", "first", "low", "mixed", "size", F.explode(F.coalesce("docs", F.array("doc"))).alias("doc"))
    return each.filter("doc > first or mixed").select(
        "doc", "whole", F.when(F.col("doc") > F.col("first"), GONE).otherwise(FIRST).cast("byte").alias("kind"), (F.col("low") < F.col("doc")).alias("ask"), "size"
    )


def _found(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    return docs.join(lists.withColumnRenamed("doc", "__doc"), F.col("doc") == F.col("__doc"), how).drop("__doc")


def _pick(u: Units, row: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of a row whose hash is wanted, and where it is in the sorted list."""
    s, e = np.searchsorted(u.doc, (row, row + 1))
    at = np.minimum(np.searchsorted(wanted, u.whole[s:e]), len(wanted) - 1)
    on = wanted[at] == u.whole[s:e]
    return s + np.flatnonzero(on), at[on]


def _strings(docs: DataFrame, firsts: DataFrame, n: int, single: bool) -> DataFrame:
    """Of first occurrences of units: rank, doc, whole, ask, off (place of the first string in the unit), lead (bytes before those of the rank) and bytes (all but those of the rank).

    `single`: every string by its own rank.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            want = batch.column(2)
            for i, j, data, offs in B.chunks(batch.column(1), 2 << 20):
                u = Units(data, offs, n)
                at, ask = [], []
                for r in range(j - i):
                    one = want[i + r].values
                    h, a = one.field(0).to_numpy(), one.field(1).to_numpy(zero_copy_only=False)
                    order = np.argsort(h)
                    picked, k = _pick(u, r, h[order])
                    _, once = np.unique(u.whole[picked], return_index=True)
                    at.append(picked[once])
                    ask.append(a[order][k[once]])
                at, ask = np.concatenate(at), np.concatenate(ask)
                if not len(at):
                    continue
                begin, end, doc = u.begin[at], u.end[at], ids[i + u.doc[at]]
                if single:
                    count = end - begin + 1
                    off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    p = np.repeat(begin, count) + off
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u.hashes(p, p + n).view(np.int64)), pa.array(np.repeat(doc, count)), pa.array(np.repeat(u.whole[at], count)), pa.array(np.repeat(ask, count)), pa.array(off.astype(np.int32))], names=["rank", "doc", "whole", "ask", "off"]
                    )
                    continue
                # Strings that start at `cut` or later hold the anchor and the 16 bytes behind it, earlier ones the 16 before it.
                anchor = u.anchors(at)
                cut = np.clip(anchor + 2 * GRAM - n, begin, end + 1)
                for side, (s, e, c) in enumerate(((cut, end, anchor), (begin, cut - 1, anchor - GRAM))):
                    k = np.flatnonzero(s <= e)
                    if not len(k):
                        continue
                    rank = (u.hashes(c[k], c[k] + 2 * GRAM) ^ np.uint64(side)).view(np.int64)
                    texts = [data[x:m].tobytes() + data[m + 2 * GRAM : y].tobytes() for x, m, y in zip(s[k].tolist(), c[k].tolist(), (e[k] + n).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rank), pa.array(doc[k]), pa.array(u.whole[at[k]]), pa.array(ask[k]), pa.array((s - begin)[k].astype(np.int32)), pa.array((c - s)[k].astype(np.int32)), pa.array(texts, pa.binary())], names=["rank", "doc", "whole", "ask", "off", "lead", "bytes"]
                    )

    wanted = firsts.filter(F.col("hot") if single else ~F.col("hot")).groupBy("doc").agg(F.collect_list(F.struct("whole", "ask")).alias("want"))
    schema = "rank long, doc long, whole long, ask boolean, off int" + ("" if single else ", lead int, bytes binary")
    return _found(docs, wanted, "inner").select("doc", "text", "want").mapInArrow(emit, schema)


def _earlier(table: pa.Table, n: int) -> pa.RecordBatch:
    """doc, whole and mask (bit k: its string k starts in an earlier document) of units that ask; rows of a rank stand together."""
    rank, doc, whole, off = (table.column(c).to_numpy() for c in ("rank", "doc", "whole", "off"))
    ask = table.column("ask").to_numpy(zero_copy_only=False)
    # What one document or no asking unit has under a rank leaves.
    new = np.ones(len(rank), bool)
    new[1:] = rank[1:] != rank[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(rank)))
    keep = np.repeat((np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)) & np.logical_or.reduceat(ask, start), size)
    table, rank, doc, whole, off, ask = table.filter(pa.array(keep)), rank[keep], doc[keep], whole[keep], off[keep], ask[keep]
    lead = table.column("lead").to_numpy()
    column = table.column("bytes").combine_chunks()
    rest = n - 2 * GRAM
    hashes, owner, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, data, offs in B.chunks(column, 2 << 20) if len(doc) else ():
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * B.powers(B._R, len(data)), out=sums[1:])
        count = np.diff(offs) - rest + 1
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        p = np.repeat(offs[:-1], count) + k
        row = np.repeat(np.arange(i, j), count)
        # Strings are alike if they have the rank, its place in them and all other bytes in common.
        others = B.mixed((sums[p + rest] - sums[p]) * B.powers(B._RI, len(data) + 1)[p])
        hashes.append(B.mixed(others + rank[row].view(np.uint64) * _C + (lead[row] - k).astype(np.uint64) * _D).view(np.int64))
        owner.append(row)
        place.append(k)
    h, row, k = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
    order = np.lexsort((doc[row], h))
    h, row, k = h[order], row[order], k[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = doc[row][np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else h
    on = (first < doc[row]) & ask[row]
    row, bit = row[on], np.int64(1) << (off[row[on]] + k[on])
    mask = np.zeros(len(doc), np.int64)
    np.bitwise_or.at(mask, row, bit)
    hit = mask != 0
    return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(whole[hit]), pa.array(mask[hit])], names=["doc", "whole", "mask"])


def find(docs: DataFrame, text: str = "text", doc: str = "doc_id", n: int = 50, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """doc, whole and mask of units that lose strings: bit k stands for the string at place k of the unit, -1 for all of them; and a table to discard afterwards.

    `hot`: units of an anchor beyond which its strings are sorted one by one, instead of what SHARE, LEAST and MOST give.
    """
    if not 3 * GRAM <= n <= 62 + GRAM:
        raise ValueError("n must be from 48 to 78")
    given = docs.filter(F.col(doc).isNotNull() & (F.octet_length(text) >= n)).select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    seen = settle(_shared(_units(given, n)))
    most = min(MOST, max(LEAST, int(seen.count() * SHARE))) if hot is None else hot
    firsts = seen.filter(F.col("kind") == FIRST).withColumn("hot", F.col("size") > most)
    alike = map_groups(_strings(given, firsts, n, False), ["rank"], lambda t: _earlier(t, n), "doc long, whole long, mask long")
    parts = [seen.filter(F.col("kind") == GONE).select("doc", "whole", F.lit(-1).cast("long").alias("mask")), alike]
    if not firsts.filter("hot").isEmpty():
        each = _strings(given, firsts, n, True)
        low = each.groupBy("rank").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").withColumnRenamed("rank", "__rank")
        late = each.filter("ask").join(low, (F.col("rank") == F.col("__rank")) & (F.col("first") < F.col("doc")))
        parts.append(late.groupBy("doc", "whole").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("mask")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, seen


def remove(docs: DataFrame, text: str = "text", doc: str = "doc_id", n: int = 50, hot: int | None = None) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left) to the documents."""
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    df = docs.drop(*added)
    names = df.columns
    found, seen = find(df, text, doc, n, hot)
    found = settle(found)
    discard(seen)
    lists = found.groupBy(F.col("doc").alias("__of")).agg(F.collect_list(F.struct("whole", "mask")).alias("__lost"))
    met = df.join(lists, F.col(doc).cast("long") == F.col("__of"), "left").select(*names, "__lost")
    schema = df.withColumns({c: F.lit(0).cast("long") for c in added[:3]}).withColumn("kept", F.lit(b"")).schema
    at = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            lost = batch.column(len(names))
            for i, j, data, offs in B.chunks(batch.column(at), 2 << 20):
                some = [r for r in range(j - i) if lost[i + r].is_valid]
                u = Units(data, offs, n) if some else None
                gone = np.zeros(len(data) + 1, np.int32)
                for r in some:
                    one = lost[i + r].values
                    h, mask = one.field(0).to_numpy(), one.field(1).to_numpy()
                    # A unit may have got marks from both of its sides.
                    order = np.argsort(h)
                    new = np.ones(len(h), bool)
                    new[1:] = h[order][1:] != h[order][:-1]
                    h, mask = h[order][new], np.bitwise_or.reduceat(mask[order], np.flatnonzero(new))
                    picked, k = _pick(u, r, h)
                    begin, count = u.begin[picked], u.end[picked] - u.begin[picked] + 1
                    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    on = (np.repeat(mask[k], count) >> place & 1).astype(bool)
                    p = (np.repeat(begin, count) + place)[on]
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + n, -1)
                dead = np.cumsum(gone[:-1]) > 0
                edge = dead.copy()
                edge[1:] &= ~dead[:-1]
                edge[offs[:-1][offs[:-1] < len(data)]] = dead[offs[:-1][offs[:-1] < len(data)]]
                for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    d = dead[s:e]
                    sizes.append(e - s)
                    removed.append(int(d.sum()))
                    spans.append(int(edge[s:e].sum()))
                    kept.append((data[s:e][~d] if removed[-1] else data[s:e]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=[*names, *added])

    return met.mapInArrow(cut, schema)
