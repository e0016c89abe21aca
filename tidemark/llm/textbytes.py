"""Words and hashes of many texts at once, from the bytes of an Arrow column.

Texts come as chunks: `data`, the UTF-8 bytes of some texts one after the other, and `offs`, where each begins, with
the end of the last.  All patterns used here split at ASCII characters, so bytes are as good as characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A-Z as a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What is not white space (0x20, 0x09-0x0D).
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and all above ASCII, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of text that a worker works on at once where whole texts pass by: the arrays made of a byte take about 50 bytes.
PIECE = 1 << 19

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RI = np.uint64(pow(int(_R), -1, 1 << 64))
_Q = np.uint64(0xD1342543DE82EF95)
_QI = np.uint64(pow(int(_Q), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(column: pa.Array | pa.ChunkedArray, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, row after the last, data, offs; null texts are empty.  A chunk has at most `most` bytes, or one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    body = column.buffers()[2] if n else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def slices(batch: pa.RecordBatch, k: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of each chunk of column k, without a copy."""
    for i, j, _, _ in chunks(batch.column(k), most):
        yield batch.slice(i, j - i)


class Words:
    """Runs of kept bytes: begin, end (in data), doc (row of the chunk), and at: the first word of each row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, keep: np.ndarray = SOLID, lower: bool = True):
        self.data = LOWER[data] if lower else data
        on = keep[self.data]
        n = len(on)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.zeros(n, bool)
        before[1:] = on[:-1]
        after = np.zeros(n, bool)
        after[:-1] = on[1:]
        self.begin = np.flatnonzero(on & (~before | edge[:n]))
        self.end = np.flatnonzero(on & (~after | edge[1:])) + 1
        self.at = np.searchsorted(self.begin, offs)
        self.count = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)
        self._sum: np.ndarray | None = None

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all words with a space after each, and where each word begins there."""
        size = self.end - self.begin
        at = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1] + 1, out=at[1:])
        out = np.full(int(size.sum()) + len(size), 32, np.uint8)
        mark = np.zeros(len(out) + 1, np.int8)
        mark[at] = 1
        mark[at + size] -= 1
        held = np.zeros(len(self.data) + 1, np.int8)
        held[self.begin] = 1
        held[self.end] -= 1
        out[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)] = self.data[np.cumsum(held[:-1], dtype=np.int8).astype(bool)]
        return out, at

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.hash_of(self.begin, self.end)

    def hash_of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        n = len(self.data)
        if self._sum is None:
            self._sum = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_R, n), out=self._sum[1:])
        return mixed((self._sum[end] - self._sum[begin]) * powers(_RI, n + 1)[begin])


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of n words of one row."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_Q, len(hashes)), out=total[1:])
    first = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return first, mixed((total[first + n] - total[first]) * powers(_QI, len(hashes))[first])
