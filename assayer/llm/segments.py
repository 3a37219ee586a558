"""Cached encoding of repeated text segments, with compact results for whole batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np


class Segments:
    """Codes for segments; each new segment is encoded once, in batches, while it stays cached.

    ``encode`` turns a list of new segments into one integer array each (rows of ``width`` columns).
    Beyond ``limit`` segments the cache starts anew between batches, so memory stays bounded.
    """

    def __init__(self, encode: Callable[[list], list[np.ndarray]], limit: int = 400_000, width: int = 1):
        self._encode, self._limit, self._width = encode, limit, width
        self._reset()

    def _reset(self) -> None:
        new = self._new = []

        class Codes(dict):
            def __missing__(self, key):
                code = self[key] = len(self)
                new.append(key)
                return code

        self._codes = Codes()
        self._at, self._values = np.zeros(1, np.int64), np.zeros((0, self._width), np.int32)

    def codes(self, segments: Sequence) -> np.ndarray:
        lookup = self._codes
        return np.fromiter(map(lookup.__getitem__, segments), np.int64, len(segments))

    def trim(self) -> None:
        """Call between batches, when no codes are held any more."""
        if len(self._codes) > self._limit:
            self._reset()

    def values(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all codes one after the other, and the number of rows for each code."""
        if self._new:
            rows = self._encode(self._new)
            self._new.clear()
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(sizes)])
            flat = np.fromiter(chain.from_iterable(rows), np.int32) if self._width == 1 else np.concatenate(rows)
            flat = flat.reshape(-1, self._width)
            self._values = np.concatenate([self._values, flat])
        sizes = self._at[codes + 1] - self._at[codes]
        ends = np.cumsum(sizes)
        take = np.repeat(self._at[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self._values[take], sizes


class HashedSegments(Segments):
    """The same for segments known by 64-bit hashes, so that only new ones become Python objects."""

    def codes_of(self, hashes: np.ndarray, segment) -> np.ndarray:
        """Codes of all hashes; ``segment(i)`` gives the text of the i-th where it is new."""
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known, lookup = len(self._codes), self._codes
        codes = np.fromiter(map(lookup.__getitem__, unique.tolist()), np.int64, len(unique))
        self._new[:] = [segment(i) for i in first[codes >= known].tolist()]
        return codes[inverse]
