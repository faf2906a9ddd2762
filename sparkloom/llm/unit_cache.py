"""Encode many repeated byte strings: each distinct one is encoded once while it stays in a bounded table."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np


class _Index(dict):
    """Numbers keys as they come and keeps the new ones for encoding."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self.fresh.append(key)
        self[key] = n = len(self)
        return n


class UnitCache:
    """encode(units) gives the ids of all units end to end and the number of ids of each.

    ``many`` encodes a list of byte strings. Beyond ``limit`` units or ``room`` ids, between calls, the table
    keeps the units that came again in a later call, if they are at most half of it: results never depend on what it holds.
    """

    def __init__(self, many: Callable[[list[bytes]], list], limit: int = 300_000, room: int = 6_000_000) -> None:
        self.many, self.limit, self.room = many, limit, room
        self._clear()

    def _clear(self) -> None:
        self.index, self.starts, self.sizes = _Index(), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0
        self.again = np.zeros(1024, bool)

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.again[: len(self.index)])
        sizes = self.sizes[keep]
        if 2 * len(keep) > self.limit or 2 * int(sizes.sum()) > self.room:
            return self._clear()
        keys, index = list(self.index), _Index()
        for n, k in enumerate(keep.tolist()):
            index[keys[k]] = n
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.starts[keep] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.index, self.starts, self.sizes, self.used = index, np.append(ends - sizes, np.zeros(1024, np.int64)), np.append(sizes, np.zeros(1024, np.int64)), len(flat)
        self.flat, self.again = np.append(flat, np.zeros(4096, np.uint32)), np.zeros(len(self.starts), bool)

    def _learn(self) -> None:
        fresh, n = self.index.fresh, len(self.index)
        found = self.many(fresh)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        while len(self.starts) < n:
            self.starts, self.sizes, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.again))
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.uint32)])
        first = n - len(fresh)
        self.sizes[first:n] = sizes
        self.starts[first:n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, total)
        self.used += total
        self.index.fresh = []

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.limit or self.used > self.room:
            self._shrink()
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        self.again[at[at < known]] = True
        if self.index.fresh:
            self._learn()
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)
        return self.flat[take], sizes


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold up to ``most`` bytes; one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j
        i = j
