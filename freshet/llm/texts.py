"""Vectorised words, lines and hashes over Arrow string columns.

All functions work on one bounded chunk of rows: ``buf`` holds the UTF-8 bytes of its texts
end to end and ``offs`` the n + 1 row boundaries. A text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 1000
#: Most rows and bytes of an Arrow batch (a longer row is a batch of its own): with the defaults of 10,000 and 64 MB, much text lies in memory on both sides of a worker's pipe.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20
#: Rows of a batch of a few numbers a row.
WIDE_ROWS = 1 << 16
#: Bits of a shingle's hash; the ten above hold the row within a chunk while sorting.
HASH_BITS = 54

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Splits at everything but ASCII letters, digits, apostrophes and bytes of longer characters.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def small_batches() -> None:
    """Lowers the session's rows and bytes per Arrow batch to ``BATCH_ROWS`` and ``BATCH_BYTES``."""
    conf = SparkSession.active().conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(conf.get(key).rstrip("bB")) <= most:
            conf.set(key, str(most))


def wide_batches() -> None:
    """Raises the session's rows per Arrow batch for narrow rows; ``BATCH_BYTES`` still holds."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(WIDE_ROWS))


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def trim() -> None:
    """Gives freed memory back, since Python workers live on after a task."""
    if libc := _libc():
        libc.malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow with small batches and without memory kept between tasks."""
    small_batches()

    def inner(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (xor-shift and multiply rounds)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chunks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buf, offs) of consecutive chunks; null texts count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n = len(col)
    if n == 0:
        return
    offs = np.frombuffer(col.buffers()[1], width, n + 1, col.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + CHUNK_BYTES, "right")) - 1
        j = min(max(j, i + 1), i + CHUNK_ROWS, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a text longer than a chunk are not kept."""
    found = _powers
    if len(found["up"]) < n:
        size, found = max(n, CHUNK_BYTES + 1), {}
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            found[key] = np.cumprod(p, dtype=np.uint64)
        if size == CHUNK_BYTES + 1:
            _powers.update(found)
    return found["up"], found["down"]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes wherever they stand."""
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def pieces(buf: np.ndarray, offs: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes outside ``splits``, none crossing rows."""
    n = len(buf)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = ~splits[buf]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first, last = offs[:-1][offs[:-1] < offs[1:]], offs[1:][offs[:-1] < offs[1:]] - 1
    starts[first] |= inside[first]
    ends[last] |= inside[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All indices of start[k]:end[k], one range after the other."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """buf[start:end] of each pair as a string."""
    offs = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offs[1:])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offs), pa.py_buffer(buf[ranges(start, end)]))


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the newline-split lines, empty ones included."""
    breaks = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    row = np.repeat(np.arange(len(offs) - 1), np.bincount(np.searchsorted(offs, breaks, "right") - 1, minlength=len(offs) - 1) + 1)
    cut = np.concatenate([row[1:] != row[:-1], [True]])
    end = np.where(cut, offs[row + 1], np.concatenate([start[1:] - 1, [0]]))
    return start, end, row


def windows(words: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of ``width`` words within a row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, 0x51ED270B7A4F3C11, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n])
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return h[at], at


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys ``row << 54 | hash`` of each row's distinct shingles, and the sizes of the sets.

    Words are runs of non-white bytes with A-Z lowered. A row with fewer words than ``width`` has its
    whole sequence as one shingle, a row without words has none.
    """
    n = len(offs) - 1
    buf = LOWER[buf]
    start, end, row = pieces(buf, offs, WHITE)
    words = span_hashes(buf, start, end)
    hashes, at = windows(words, row, width)
    rows = row[at]
    count = np.bincount(row, minlength=n)
    for w in range(1, width):
        if (short := np.flatnonzero(count == w)).size:
            h, at = windows(words, row, w)
            mine = np.isin(row[at], short)
            hashes, rows = np.concatenate([hashes, mix(h[mine] + np.uint64(w))]), np.concatenate([rows, row[at][mine]])
    keys = (rows.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes >> np.uint64(64 - HASH_BITS))
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys, np.bincount((keys >> np.uint64(HASH_BITS)).astype(np.int64), minlength=n)
