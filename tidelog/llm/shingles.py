"""Word shingles as 64-bit hashes, for whole Arrow columns at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes whose hashes are worked out at once; a longer word is taken whole.
BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_kept: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xCA5A826395121157)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White-space flags and hash values by byte (A to Z as a to z), and n powers of the base and of its inverse."""
    if "space" not in _kept:
        byte = np.arange(256)
        _kept["space"] = (byte == 32) | ((byte >= 9) & (byte <= 13))
        low = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint64)
        _kept["value"] = mixed((low + np.uint64(1)) * np.uint64(_ODD))
    if len(_kept.get("up", ())) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(max(n, BLOCK + 1), base, np.uint64)
            steps[0] = 1
            _kept[name] = np.multiply.accumulate(steps)
    return _kept["space"], _kept["value"], _kept["up"], _kept["down"]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' len + 1 offsets in them; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, in order, and the offsets of each row's words among them."""
    space, *_ = _tables(BLOCK)
    inside = np.concatenate(([False], ~space[data], [False]))
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True  # a row's first byte begins a word of its own
    begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    out = np.empty(len(begins), np.uint64)
    w = 0
    while w < len(begins):
        to = max(w + 1, int(np.searchsorted(ends, begins[w] + BLOCK, "right")))
        lo, hi = int(begins[w]), int(ends[to - 1])
        _, value, up, down = _tables(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value[data[lo:hi]] * up[: hi - lo], out=total[1:])
        b, e = begins[w:to] - lo, ends[w:to] - lo
        out[w:to] = mixed((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64) * np.uint64(_ODD))
        w = to
    return out, np.searchsorted(begins, at)


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int = WORDS) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingles: k words, or the whole row if it has fewer; none if it has no word."""
    factor = mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1)
    if len(words) >= k:
        n = len(words) - k + 1
        windows = words[:n] * factor[0]
        for i in range(1, k):
            windows = windows + words[i : n + i] * factor[i]
        windows = mixed(windows)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= k:
            found = np.sort(windows[lo : hi - k + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif hi > lo:
            short = (words[lo:hi] * factor[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            yield mixed(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def release() -> None:
    """Drops this process's tables, and gives the system back what is free."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(work: Work, after: Callable[[], None] | None = None) -> Work:
    """The same work; what it no longer needs goes back to the system when a task ends, as workers serve many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            if after:
                after()
            release()

    return run


def in_pieces(batch: pa.RecordBatch, text: int | pa.Array, most: int = BLOCK, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (a column's place, or the texts) hold about `most` bytes together, one row at
    least and `rows` at most."""
    _, at = bytes_of(batch.column(text) if isinstance(text, int) else text)
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi
