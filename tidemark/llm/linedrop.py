"""Line dedup with a log-template tree of fixed depth.

A line's tokens go down a tree: first by their number, then by the `LEAD` leading tokens, where a token with a digit
counts as a variable.  In a leaf, lines generalise to templates: the places behind the leading tokens are cut into pieces,
and a template is a line with up to two pieces left open, a share of 1 - `alike` of its places at most.  So every line has
a fixed set of templates of its own, whatever other lines there are, and lines that differ in up to two fields share one.
A line is dropped from all documents if it, or one of its templates, recurs in `min_docs` or more; of those with more than
`long_tokens` tokens, `long_docs` documents are enough, as such passages do not recur by chance.

Templates are hashes, so lines meet in sums by hash and are never compared in pairs; the result does not depend on the
order or the number of lines.  Equal lines (but for variables) are counted first.  Only leaves with several lines are
generalised.  A template with one line that recurs by itself recurs too; of the others, which have few documents a line,
the documents are counted once each.  Lines of under `min_tokens` tokens are never dropped.  Documents with equal texts
count once, as copies of one document are no boilerplate.

Defined results: a null text stays null and has no lines, an empty one has one empty line; there are no ties; repeated rows
are documents with equal texts; other columns are kept, but n_lines, n_dropped and words_dropped replace columns of these
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as B
from tidemark.llm.stage import discard, settle

LEAD = 3
#: Rows (of 8 or 16 bytes) that are broadcast at most; beyond it, a join does the same.
BROADCAST_ROWS = 1_000_000
VARIABLE = np.uint64(0x5BF03635)
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True


class Lines:
    """Of a chunk's lines: begin, end, doc, number of tokens, form (hash of all tokens, variables masked) and leaf."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        w = B.Words(data, offs, B.SOLID)
        breaks = np.flatnonzero(data == 10)
        extra = np.bincount(np.searchsorted(offs, breaks, "right") - 1, minlength=len(offs) - 1)
        at = np.concatenate([[0], np.cumsum(extra + 1)])
        begin = np.empty(at[-1], np.int64)
        begin[at[:-1]] = offs[:-1]
        rest = np.ones(at[-1], bool)
        rest[at[:-1]] = False
        begin[rest] = breaks + 1
        end = np.empty_like(begin)
        end[:-1] = begin[1:] - 1
        end[at[1:] - 1] = offs[1:]
        self.begin, self.end, self.at = begin, np.maximum(begin, end), at
        self.doc = np.repeat(np.arange(len(offs) - 1), extra + 1)
        digits = np.zeros(len(data) + 1, np.int32)
        np.cumsum(DIGITS[data], dtype=np.int32, out=digits[1:])
        self.token = w.hashes()
        self.token[digits[w.end] > digits[w.begin]] = VARIABLE
        self.first = np.searchsorted(w.begin, begin)
        self.count = np.searchsorted(w.begin, self.end) - self.first
        total = np.zeros(len(self.token) + 1, np.uint64)
        np.cumsum(self.token * B.powers(B._Q, len(self.token)), out=total[1:])
        back = B.powers(B._QI, len(self.token) + 1)

        def upto(n: np.ndarray) -> np.ndarray:
            h = (total[self.first + n] - total[self.first]) * back[self.first]
            return B.mixed(h ^ (self.count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)

        self.form = upto(self.count)
        self.leaf = upto(np.minimum(self.count, LEAD))


def _ids(docs: DataFrame, text: str, min_tokens: int, long_tokens: int = 50) -> DataFrame:
    """form, leaf, long (over `long_tokens` tokens) and doc (hash of the text) of every distinct line of a document with enough tokens."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offs in B.chunks(batch.column(1)):
                x = Lines(data, offs)
                on = np.flatnonzero(x.count >= min_tokens)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x.form[on], x.leaf[on], x.count[on] > long_tokens, doc[i + x.doc[on]])], names=["form", "leaf", "long", "doc"])

    return docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("doc"), text).mapInArrow(emit, "form long, leaf long, long boolean, doc long").distinct()


def _tokens(docs: DataFrame, text: str, min_tokens: int) -> DataFrame:
    """form, leaf and token hashes (32 bits each) of lines, once for each chunk."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in B.chunks(batch.column(0)):
                x = Lines(data, offs)
                _, once = np.unique(x.form, return_index=True)
                on = once[x.count[once] >= min_tokens]
                short = (x.token >> np.uint64(32)).astype(np.uint32)
                tokens = [short[a : a + n].tobytes() for a, n in zip(x.first[on].tolist(), x.count[on].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x.form[on]), pa.array(x.leaf[on]), pa.array(tokens, pa.binary())], names=["form", "leaf", "tokens"])

    return docs.filter(F.col(text).isNotNull()).select(text).mapInArrow(emit, "form long, leaf long, tokens binary")


def openings(n: int, alike: float) -> list[tuple[tuple[int, int], ...]]:
    """The places that the templates of a line of n tokens leave open, as pieces [from, to)."""
    most = int(n * (1 - alike) + 1e-9)
    if n <= LEAD or not most:
        return []
    size = max(1, most // 2)
    pieces = [(i, min(n, i + size)) for i in range(LEAD, n, size)]
    return list(combinations(pieces, min(2 if most > 1 else 1, len(pieces))))


def _generalised(lines: DataFrame, alike: float) -> DataFrame:
    """template, form, long and n of each line (form, leaf, long, n, tokens)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, leaf, n = (batch.column(k).to_numpy() for k in (0, 1, 3))
            tokens = batch.column(4)
            sizes = np.array([len(t) // 4 for t in tokens.to_pylist()]) if len(form) else np.zeros(0, np.int64)
            for size in np.unique(sizes).tolist():
                on = np.flatnonzero(sizes == size)
                ways = openings(size, alike)
                if not ways:
                    continue
                words = np.frombuffer(b"".join(tokens.take(pa.array(on)).to_pylist()), np.uint32).reshape(len(on), size).astype(np.uint64)
                total = np.zeros((len(on), size + 1), np.uint64)
                np.cumsum((words + np.uint64(1)) * B.powers(B._Q, size), axis=1, out=total[:, 1:])
                for k, way in enumerate(ways):
                    rest = total[:, -1].copy()
                    for i, j in way:
                        rest -= total[:, j] - total[:, i]
                    key = B.mixed(B.mixed(rest) + leaf[on].view(np.uint64) * np.uint64(2 * k + 1)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(form[on]), batch.column(2).take(pa.array(on)), pa.array(n[on])], names=["template", "form", "long", "n"])

    return lines.select("form", "leaf", "long", "n", "tokens").mapInArrow(emit, "template long, form long, long boolean, n long")


def recurring(docs: DataFrame, text: str = "text", min_docs: int = 5, min_tokens: int = 4, alike: float = 0.7, long_tokens: int = 50, long_docs: int = 2) -> DataFrame:
    """form: the lines that recur, or a template of which recurs."""
    ids = settle(_ids(docs, text, min_tokens, long_tokens))
    enough = F.when(F.col("long"), long_docs).otherwise(min_docs)
    forms = ids.groupBy("form", "leaf", "long").agg(F.count(F.lit(1)).alias("n"))
    leaves = forms.groupBy("leaf", "long").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n")).filter((F.col("forms") > 1) & (F.col("n") >= enough))
    leaves = settle(leaves.select(F.col("leaf").alias("leaf2")).distinct())
    within = F.broadcast(leaves) if leaves.count() <= BROADCAST_ROWS else leaves
    tokens = _tokens(docs, text, min_tokens).join(within, F.col("leaf") == F.col("leaf2")).groupBy(F.col("form").alias("f2")).agg(F.first("tokens").alias("tokens"))
    keys = settle(_generalised(forms.join(tokens, F.col("form") == F.col("f2")), alike))
    met = keys.groupBy("template", "long").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("met"), F.max("n").alias("most"))
    met = met.filter((F.col("lines") > 1) & (F.col("met") >= enough)).select(F.col("template").alias("t2"), (F.col("most") >= enough).alias("sure"))
    some = settle(keys.join(met, F.col("template") == F.col("t2")).select("template", "form", "long", "sure"))
    open_ = some.filter("not sure").select("template", F.col("form").alias("f2"))
    each = ids.join(open_, F.col("form") == F.col("f2")).select("template", "long", "doc").distinct()
    often = each.groupBy("template", "long").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough).select(F.col("template").alias("t2"))
    alone = forms.filter(F.col("n") >= enough).select("form")
    shared = some.filter("sure").select("form").union(some.filter("not sure").join(often, F.col("template") == F.col("t2"), "left_semi").select("form"))
    out = settle(alone.union(shared).distinct())
    discard(ids, leaves, keys, some)
    return out


def drop(docs: DataFrame, text: str = "text", min_docs: int = 5, min_tokens: int = 4, alike: float = 0.7, long_tokens: int = 50, long_docs: int = 2) -> DataFrame:
    """The documents with `text` less its recurring lines; adds n_lines, n_dropped and words_dropped."""
    bad = recurring(docs, text, min_docs, min_tokens, alike, long_tokens, long_docs)
    new = ["n_lines", "n_dropped", "words_dropped"]
    df = docs.drop(*new)
    names = df.columns
    few = bad.count() <= BROADCAST_ROWS
    schema = df.withColumns({c: F.lit(0).cast("long") for c in new}).schema
    if few:
        given = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r[0] for r in bad.toLocalIterator()), np.int64))
    else:
        of = _ids(docs, text, min_tokens).join(bad, "form", "left_semi").groupBy(F.col("doc").alias("__of")).agg(F.collect_set("form").alias("__bad"))
        df = df.withColumn("__doc", F.xxhash64(text)).join(of, F.col("__doc") == F.col("__of"), "left").select(*names, "__bad")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = names.index(text)
            found = {c: np.zeros(batch.num_rows, np.int64) for c in new}
            own = None if few else batch.column(len(names)).to_pylist()
            nulls = batch.column(k).is_null().to_numpy(zero_copy_only=False)
            texts: list[bytes | None] = []
            for i, j, data, offs in B.chunks(batch.column(k)):
                x = Lines(data, offs)
                if few:
                    table = given.value
                    hit = table[np.minimum(np.searchsorted(table, x.form), len(table) - 1)] == x.form if len(table) else np.zeros(len(x.form), bool)
                else:
                    hit = np.array([f in (own[i + d] or ()) for f, d in zip(x.form.tolist(), x.doc.tolist(), strict=True)], bool)
                hit &= x.count >= min_tokens
                found["n_lines"][i:j] = np.diff(x.at)
                found["n_dropped"][i:j] = np.add.reduceat(hit.astype(np.int64), x.at[:-1])
                found["words_dropped"][i:j] = np.add.reduceat(np.where(hit, x.count, 0), x.at[:-1])
                for d in range(j - i):
                    if not found["n_dropped"][i + d]:
                        texts.append(data[offs[d] : offs[d + 1]].tobytes())
                        continue
                    stay = [r for r in range(x.at[d], x.at[d + 1]) if not hit[r]]
                    texts.append(b"\n".join(data[x.begin[r] : x.end[r]].tobytes() for r in stay))
            for r in np.flatnonzero(nulls):
                texts[r] = None
                found["n_lines"][r] = 0
            columns = list(batch.columns[: len(names)])
            columns[k] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[c]) for c in new)], names=[*names, *new])

    return df.mapInArrow(clean, schema)
