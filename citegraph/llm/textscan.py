"""Vectorised scans over a batch of whole texts, for use inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that are held as work arrays at a time; a longer text is taken alone
CHUNK = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)  # a value for each byte

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK):
    """Consecutive slices of ``batch`` with at most ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        got = [np.cumprod(np.full(size, b, np.uint64)) for b in (BASE, _INVERSE)]
        if n > CHUNK + 1:  # not kept for one long text
            return got[0], got[1]
        _POWERS[:] = got
    return _POWERS[0], _POWERS[1]


class Texts:
    """Bytes of many texts end to end; null texts are empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column.cast(pa.string()) if column.type != pa.string() else column, "")
        self.n = len(column)
        off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + self.n + 1].astype(np.int64)
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        if lower:
            self.data = LOWER[self.data]
        self.off = off - off[0]
        self._sums = None

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Count of true bytes of each text."""
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[self.off[1:]] - sums[self.off[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text number) of the maximal runs of true bytes inside the texts."""
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.off] = True
        first, last = inside.copy(), inside.copy()
        if len(inside):
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, self.doc_of(start)

    def words(self):
        return self.runs(~SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text number) of the non-empty \\n-split lines."""
        return self.runs(self.data != 10)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span, equal for equal bytes."""
        up, down = _powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64))


def windows(values: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first index) of the windows of ``k`` consecutive values of one text."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = values[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(BASE) + values[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(out[at]), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    return np.isin(keys, np.unique(twice))


def distinct_per_doc(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each text."""
    order = np.lexsort((keys, doc)) if len(keys) else np.zeros(0, np.int64)
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)
