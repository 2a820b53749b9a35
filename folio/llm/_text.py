"""Vectorised handling of whole Arrow text columns: words, their hashes, windows of words.

All of it works on the bytes of a batch at once. Words are runs of bytes outside
``[\\x20\\x09-\\x0D]``; no word spans two rows. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between tasks, as pools of workers would not
CHUNK = 1 << 21  # bytes of text handled at once (one longer text is handled alone)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_P, _PI)):
            full = np.full(size, base)
            full[0] = 1
            _powers[k] = np.cumprod(full)
    return _powers[0][:n], _powers[1][:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of values[s:e] (uint64) for each span; equal spans have equal hashes wherever they stand."""
    pw, inv = powers(len(values) + 1)
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * pw[: len(values)], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts (n + 1 offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def _trim() -> None:
    """Hand free memory back to the system: workers live on through many tasks."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        _, o = flat(col)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        _trim()


class Words:
    """The words of a chunk of texts: byte spans `starts`, `ends` in `data`; row i has the words rows[i]:rows[i + 1]."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = flat(column)
        n, d = len(self.offsets) - 1, self.data
        solid = np.ones(len(d) + 2, bool)
        solid[0] = solid[-1] = False
        np.logical_not(_SPACE[d], out=solid[1:-1])
        body = solid[1:-1]
        first = body & ~solid[:-2]
        last = body & ~solid[2:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(d))]
        first[cuts] |= body[cuts]
        last[cuts - 1] |= body[cuts - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, self.offsets)
        self.n = n

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def hashes(self, block: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word, block by block of bytes."""
        out, at, n = np.empty(len(self), np.uint64), 0, len(self)
        while at < n:
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + block, "right")))
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            out[at:to] = spans_hash(_BYTE[self.data[base : base + e[-1]]], s, e)
            at = to
        return out

    def same(self, i: np.ndarray, j: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        """Whether the words i equal the words j, byte for byte."""
        size = self.ends - self.starts
        out = size[i] == size[j]
        for k in range(0, len(i), block):
            ok = np.flatnonzero(out[k : k + block]) + k
            n = size[i[ok]]
            differs = self.data[ranges(self.starts[i[ok]], n)] != self.data[ranges(self.starts[j[ok]], n)]
            bad = np.flatnonzero(differs)
            if len(bad):
                out[ok[np.searchsorted(np.cumsum(n), bad, "right")]] = False
        return out

    def same_windows(self, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
        """Whether the windows at words i (ascending) equal those at words j. Where a pair follows its neighbour only its last word is compared."""
        if not len(i):
            return np.zeros(0, bool)
        follows = np.zeros(len(i), bool)
        follows[1:] = (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1)
        heads = np.flatnonzero(~follows)
        head_ok = np.ones(len(heads), bool)
        for k in range(size - 1):
            head_ok &= self.same(i[heads] + k, j[heads] + k)
        last = self.same(i + size - 1, j + size - 1)
        if last.all() and head_ok.all():
            return last
        bad = np.zeros(len(i) + 1, np.int64)  # a pair is equal if the last `size` steps of its run and, near its head, the head are
        np.cumsum(~last, out=bad[1:])
        k = np.arange(len(i))
        head = heads[np.searchsorted(heads, k, "right") - 1]
        near = k - head < size
        wrong = bad[k + 1] - bad[np.where(near, head, k - size + 1)] > 0
        wrong |= near & np.repeat(~head_ok, np.diff(np.append(heads, len(i))))
        return ~wrong

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def text(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """The row's words (where keep) joined by one space."""
        a, b = self.rows[row], self.rows[row + 1]
        s, e = self.starts[a:b], self.ends[a:b]
        if keep is not None:
            s, e = s[keep], e[keep]
        raw = self.data
        return b" ".join([raw[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist(), strict=True)])


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window of `size` words within a row, and the window's hash."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    room = np.repeat(words.rows[1:], words.counts)[: n - size + 1] - np.arange(n - size + 1)
    at = np.flatnonzero(room >= size)
    return at, spans_hash(hashes, at, at + size)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many spans behind one another, and their offsets."""
    size = ends - starts
    o = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=o[1:])
    return data[np.arange(o[-1]) + np.repeat(starts - o[:-1], size)], o


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), starts[1], ..."""
    o = np.cumsum(sizes)
    return np.arange(o[-1] if len(o) else 0) + np.repeat(starts - (o - sizes), sizes)


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
