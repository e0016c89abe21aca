"""Quality of documents from a linear-chain conditional random field over their lines.

Each line is good (1) or bad (0).  A line's features are its shape (length, shares of character kinds, words, repeats)
and the shapes of the line before and after; neighbouring labels are tied by learned transitions.  The field is
fitted by gradient ascent to labelled documents, whose lines all carry the document's label; a document's score is the
mean of its lines' forward-backward marginals, weighted by the lines' lengths in bytes.

Fitting uses the labelled rows with the smallest hashes, `sample` at most, of these the documents of `most_lines` lines at
most, and of these, from the smallest hash on, as many as have `all_lines` lines together.  Only their line features come
to the driver (88 bytes a line, and about 400 while the field is fitted), and of a document only the label and the lines
enter, never its language, source or id.  Scoring reads every text.

Defined results: rows that share an id count as the one whose text has the smallest hash; a null or empty text, or one of line breaks alone, has one empty line, and is scored by that line's
features like any other; without labelled rows every score is 0.5; repeated rows get equal scores; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import textbytes as B

#: Labelled documents that a fit takes at most, lines of one of them, and lines of all.
SAMPLE, MOST_LINES, ALL_LINES = 4_000, 1_000, 1_000_000


def _kind(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


KINDS = {
    "lower": _kind("abcdefghijklmnopqrstuvwxyz"),
    "upper": _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _kind("0123456789"),
    "space": _kind(" \t\r\x0b\x0c"),
    "stop": _kind(".,;:'\"?-()"),
    "shout": _kind("!"),
    "bar": _kind("|"),
    "odd": _kind("#$%&*+/<=>@[\\]^_`{}~"),
}
HIGH = np.arange(256) >= 128


@dataclass
class Lines:
    """Shapes of lines, bytes of each, and the first line of each document (with the end of the last)."""

    shape: np.ndarray
    size: np.ndarray
    at: np.ndarray


def lines(data: np.ndarray, offs: np.ndarray) -> Lines:
    """The lines of a chunk; every document has one at least."""
    n_docs = len(offs) - 1
    breaks = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(offs, breaks, "right") - 1
    extra = np.bincount(doc_of, minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(extra + 1)])
    doc = np.repeat(np.arange(n_docs), extra + 1)
    # In document order: the document's begin, then one line after each of its breaks.
    begin = np.empty(at[-1], np.int64)
    begin[at[:-1]] = offs[:-1]
    rest = np.ones(at[-1], bool)
    rest[at[:-1]] = False
    begin[rest] = breaks + 1
    end = np.empty_like(begin)
    end[:-1] = begin[1:] - 1
    last = at[1:] - 1
    end[last] = offs[1:]
    size = np.maximum(end - begin, 0)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, dtype=np.int32, out=total[1:])
        return (total[begin + size] - total[begin]).astype(float)

    kinds = {k: count(t[data]) for k, t in KINDS.items()}
    high = count(HIGH[data])
    every = B.Words(data, offs, B.SOLID, lower=False)
    starts = np.zeros(len(data), bool)
    starts[every.begin] = True
    words = count(starts)
    # Words that the one before them in the line equals.
    h, same = every.hashes(), np.zeros(len(data), bool)
    line_of = np.searchsorted(begin, every.begin, "right")
    same[every.begin[1:][(h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])]] = True
    echo = count(same) / np.maximum(words, 1)
    chars = np.maximum(size, 1).astype(float)
    letters = np.maximum(kinds["lower"] + kinds["upper"], 1)
    # Lines that an earlier line of the document equals.
    text = every.hash_of(begin, begin + size) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(text, return_index=True)
    repeat = np.ones(len(begin))
    repeat[first] = 0
    odd, bar, shout = kinds["odd"] / chars, kinds["bar"] / chars, kinds["shout"] / chars
    upper = kinds["upper"] / letters
    shape = np.stack(
        [
            np.log1p(size) / 5, np.log1p(words) / 3, np.minimum(chars / np.maximum(words, 1), 40) / 10, (words <= 3) * 1.0, (words >= 12) * 1.0, (size == 0) * 1.0,
            kinds["lower"] / chars, upper, (upper > 0.6) * 1.0, kinds["digit"] / chars * 3, kinds["stop"] / chars * 5, shout * 10, (shout > 0.03) * 1.0,
            bar * 10, (bar > 0.03) * 1.0, odd * 5, (odd > 0.05) * 1.0, high / chars, repeat, echo, (echo > 0.15) * 1.0,
        ],
        axis=1,
    )
    return Lines(shape, size.astype(float), at)


def inputs(x: Lines) -> np.ndarray:
    """A line's shape, those of its neighbours, and marks of the document's first and last line."""
    before, after = np.zeros_like(x.shape), np.zeros_like(x.shape)
    before[1:], after[:-1] = x.shape[:-1], x.shape[1:]
    first, last = x.at[:-1], x.at[1:] - 1
    before[first] = after[last] = 0
    ends = np.zeros((len(x.shape), 3))
    ends[first, 0] = ends[last, 1] = 1
    ends[:, 2] = 1
    return np.concatenate([x.shape, before, after, ends], axis=1)


class Field:
    """Weights of the inputs for label 1 against 0, and log transitions [from, to]."""

    def __init__(self, width: int):
        self.w, self.t = np.zeros(width), np.zeros((2, 2))

    def marginals(self, e: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line; and the log odds that come from the left (with the line itself) and from the right."""
        counts = np.diff(at)
        order = np.argsort(-counts, kind="stable")
        first, sizes = at[:-1][order], counts[order]
        m = np.exp(self.t)
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        left, right = np.empty_like(e), np.zeros_like(e)
        left[first] = e[first]
        steps = np.searchsorted(-sizes, -np.arange(1, sizes[0] if len(sizes) else 0), "left")  # documents with more than t lines
        for t, live in enumerate(steps, 1):
            i = first[:live] + t
            s = sig(left[i - 1])
            left[i] = e[i] + np.log((1 - s) * m[0, 1] + s * m[1, 1]) - np.log((1 - s) * m[0, 0] + s * m[1, 0])
        for t in range(len(steps), 0, -1):
            i = first[: steps[t - 1]] + t
            s = sig(e[i] + right[i])
            right[i - 1] = np.log((1 - s) * m[1, 0] + s * m[1, 1]) - np.log((1 - s) * m[0, 0] + s * m[0, 1])
        return sig(left + right), left, right

    def fit(self, x: Lines, label: np.ndarray, steps: int = 250, rate: float = 0.1, decay: float = 1e-4) -> Field:
        """Adam on the documents' mean log likelihood.

        Inputs of neighbours are those of the line before or behind, so a line's own shape is all that is held of it.
        """
        at, parts = x.at, x.shape.shape[1]
        own, first, last = x.shape, x.at[:-1], x.at[1:] - 1
        y = np.repeat(label, np.diff(at)).astype(float)
        inner = np.ones(len(own), bool)
        inner[at[1:] - 1] = False
        a = np.flatnonzero(inner)
        weight = np.repeat(1 / np.sqrt(np.diff(at)), np.diff(at))
        weight /= weight.sum()
        wanted = np.zeros((2, 2))
        np.add.at(wanted, (y[a].astype(int), y[a + 1].astype(int)), weight[a])
        m1, m2 = np.zeros(len(self.w) + 4), np.zeros(len(self.w) + 4)
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        for k in range(1, steps + 1):
            mine, before, after = (self.w[i * parts : (i + 1) * parts] for i in range(3))
            e = own @ mine + self.w[-1]
            e[a + 1] += (own @ before)[a]
            e[a] += (own @ after)[a + 1]
            e[first] += self.w[-3]
            e[last] += self.w[-2]
            p, left, right = self.marginals(e, at)
            s, r, m = sig(left[a]), sig(e[a + 1] + right[a + 1]), np.exp(self.t)
            joint = np.stack([(1 - s) * m[0, 0] * (1 - r), (1 - s) * m[0, 1] * r, s * m[1, 0] * (1 - r), s * m[1, 1] * r])
            joint /= joint.sum(0)
            got = (joint * weight[a]).sum(1).reshape(2, 2)
            off = weight * (y - p)
            to_next, to_last = np.zeros(len(off)), np.zeros(len(off))
            to_next[a], to_last[a + 1] = off[a + 1], off[a]
            pull = np.concatenate([own.T @ off, own.T @ to_next, own.T @ to_last, [off[first].sum(), off[last].sum(), off.sum()]])
            g = np.concatenate([pull - decay * self.w, (wanted - got - decay * self.t).ravel()])
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            step = rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-9)
            self.w += step[:-4]
            self.t += step[-4:].reshape(2, 2)
        return self

    def score(self, x: Lines) -> np.ndarray:
        """Of each document, the mean of its lines' marginals, by length (a line counts one byte more than it has)."""
        p, _, _ = self.marginals(inputs(x) @ self.w, x.at)
        weight = x.size + 1
        return np.add.reduceat(p * weight, x.at[:-1]) / np.add.reduceat(weight, x.at[:-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, most_lines: int = MOST_LINES, all_lines: int = ALL_LINES) -> Field | None:
    """A field from the labelled documents with the smallest hashes of their keys."""
    chosen = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).filter("__y is not null and __k is not null")
    chosen = chosen.groupBy("__k").agg(F.max("__y").alias("__y")).withColumn("__o", F.xxhash64("__k")).orderBy("__o", "__k").limit(sample)
    rows = docs.join(F.broadcast(chosen), F.col(key) == F.col("__k")).select("__k", "__y", "__o", F.xxhash64(text).alias("__h"), F.col(text).alias("t"))
    count = F.coalesce(F.regexp_count("t", F.lit("\n")), F.lit(0)) + 1
    sizes = rows.filter(count <= most_lines).groupBy("__k", "__o").agg(F.min(F.struct("__h", count.alias("n"))).alias("__one"))
    # One row for each chosen label, so a window over all of them is small.
    so_far = F.sum("__one.n").over(W.orderBy("__o", "__k"))
    taken = sizes.withColumn("__sum", so_far).filter(F.col("__sum") <= all_lines).select(F.col("__k").alias("__k2"), F.col("__one.__h").alias("__h2"))
    rows = rows.join(F.broadcast(taken), (F.col("__k") == F.col("__k2")) & (F.col("__h") == F.col("__h2"))).select("__k", "__y", "t")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ys, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, j, data, offs in B.chunks(batch.column(2), B.PIECE):
                x = lines(data, offs)
                out += [(str(keys[i + d]), ys[i + d], x.shape[x.at[d] : x.at[d + 1]].astype(np.float32).tobytes(), x.size[x.at[d] : x.at[d + 1]].tobytes()) for d in range(j - i)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["k", "y", "shape", "size"])

    got = rows.mapInArrow(shapes, "k string, y int, shape binary, size binary").dropDuplicates(["k"]).toPandas().sort_values("k", kind="stable")
    if not len(got):
        return None
    size = [np.frombuffer(s) for s in got["size"]]
    shape = [np.frombuffer(s, np.float32).reshape(len(n), -1) for s, n in zip(got["shape"], size, strict=True)]
    x = Lines(np.concatenate(shape).astype(float), np.concatenate(size), np.concatenate([[0], np.cumsum([len(s) for s in size])]))
    label = got["y"].to_numpy()
    del got, shape, size
    return Field(3 * x.shape.shape[1] + 3).fit(x, label)


def score(docs: DataFrame, field: Field | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every whole text; no shuffle."""
    df = docs.drop(out)
    names = df.columns
    model = docs.sparkSession.sparkContext.broadcast(field)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What goes back at once is a piece, not a whole batch of texts.
        for batch in chain.from_iterable(B.slices(b, names.index(text)) for b in batches):
            found = np.full(batch.num_rows, 0.5)
            if model.value is not None:
                for i, j, data, offs in B.chunks(batch.column(names.index(text)), B.PIECE):
                    found[i:j] = model.value.score(lines(data, offs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(found, 0, 1))], names=[*names, out])

    return df.mapInArrow(rate, df.withColumn(out, F.lit(0.0)).schema)
