"""Vectorised words and rolling hashes over Arrow text columns.

A column's bytes lie one text after the other in one buffer, so words of thousands of
texts are found and hashed with a few numpy passes and no Python loop over rows.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Of one seed at a time: a worker that serves several stages must not keep them all.
_KEPT: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and at least ``n`` powers of a seed's base and of its inverse."""
    if seed not in _KEPT or len(_KEPT[seed][1]) < n:
        base = ((0x9E3779B97F4A7C15 * (2 * seed + 1)) | 1) & 0xFFFFFFFFFFFFFFFF
        table = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93) + _U(seed))

        def up(b: int) -> np.ndarray:
            out = np.full(n, b, _U)
            out[0] = 1
            return np.cumprod(out, dtype=_U)

        _KEPT.clear()
        _KEPT[seed] = table, up(base), up(pow(base, -1, 1 << 64))
    return _KEPT[seed]


def _room(n: int) -> int:
    return -(-(n + 1) // (1 << 20)) << 20


def release() -> None:
    """Gives memory back to the system: a worker process serves many tasks and would else keep the most that one of them took."""
    if _KEPT and max(len(kept[1]) for kept in _KEPT.values()) > 2 * _room(SLICE_BYTES):
        _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: How to give up what an operator keeps for all its tasks of a worker, by operator.
_OWN_CACHES: dict[str, Callable[[], None]] = {}


def slices(batches: Iterator[pa.RecordBatch], text: str | tuple[str, ...], limit: int = SLICE_BYTES, own: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, of all columns named; a longer text stands alone.

    Where a worker turns to another operator (``own``), it gives up what others keep in it.
    """
    for name in [n for n in _OWN_CACHES if n != own]:
        _OWN_CACHES.pop(name)()
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(sum(np.diff(offsets(plain(batch.column(c)))) for c in ((text,) if isinstance(text, str) else text)))
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def plain(column: pa.Array) -> pa.Array:
    """The column as strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def offsets(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins, counted from the first."""
    at = offsets(column)
    data = column.buffers()[2] if len(column) else None
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column: their bytes are ``data[start:end]``, ``doc`` is the row."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each row, and the number of words at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each word's bytes, the same in every process."""
        if not len(self.start):
            return np.zeros(0, _U)
        table, power, inverse = _powers(_room(len(self.data)), seed)
        total = np.zeros(len(self.data) + 1, _U)
        np.cumsum(table[self.data] * power[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(_U))


def words(column: pa.Array, lower: bool = False) -> Words:
    data, at = raw(plain(column))
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, at, empty, empty, empty, np.zeros(len(at), np.int64))
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = at[:-1][at[:-1] < n]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = at[1:][at[1:] > 0] - 1
    ends[last] = solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    return Words(data, at, start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), first)


def windows(hashes: np.ndarray, doc: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``size`` consecutive words of one document, and the first word's index."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    by = _U(((0xC2B2AE3D27D4EB4F * (2 * seed + 1)) | 1) & 0xFFFFFFFFFFFFFFFF)
    total = np.zeros(n, _U)
    for k in range(size):
        total *= by
        total += hashes[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(total[at] + _U(size)), at


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``size`` that begins at one of ``at``."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + size, n), -1)
    return np.cumsum(change[:n]) > 0
