"""Substring removal with a logarithmic family of suffix arrays.

In each shard the documents arrive in generations by doc_id. A generation's windows become a suffix array, sorted by
their first ``WIDTH`` bytes, which is all that a match of that length needs. It is merge-scanned against the
existing levels, where an equal window means a match of 50 bytes or more, and then becomes a level itself; while
the level before it is not larger, the two merge, so there are at most logarithmically many.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import NONE, WIDTH, Bytes, digest, remove

KIND = np.dtype(f"S{WIDTH}")


class Level:
    """Distinct windows in suffix order, each with the smallest id that holds it."""

    def __init__(self, windows: np.ndarray, ids: np.ndarray):
        self.windows, self.ids = windows, ids

    def __len__(self) -> int:
        return len(self.windows)

    def lookup(self, windows: np.ndarray) -> np.ndarray:
        """The smallest id for each of the sorted windows, NONE where there is no match."""
        at = np.minimum(np.searchsorted(self.windows, windows), len(self) - 1)
        return np.where(self.windows[at] == windows, self.ids[at], NONE)

    def merged(self, other: Level) -> Level:
        place = np.searchsorted(self.windows, other.windows)
        windows = np.insert(self.windows, place, other.windows)
        ids = np.insert(self.ids, place, other.ids)
        fresh = np.concatenate(([True], windows[1:] != windows[:-1]))
        return Level(windows[fresh], np.minimum.reduceat(ids, np.flatnonzero(fresh)))


class Family:
    """The levels, largest first."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, level: Level) -> np.ndarray:
        """Scans a new level against the others and keeps it; the smallest ids known for its windows."""
        least = level.ids
        for old in self.levels:
            least = np.minimum(least, old.lookup(level.windows))
        while self.levels and len(self.levels[-1]) <= len(level):
            level = self.levels.pop().merged(level)
        self.levels.append(level)
        return least


def suffix_array(contexts: list[bytes], lows: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The windows of the contexts as a level; each window's place in it, in order; the contexts' first windows."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts])
    count = size - WIDTH + 1
    first = np.concatenate(([0], np.cumsum(count)))
    start = np.repeat(np.cumsum(size) - size - first[:-1], count) + np.arange(first[-1])
    windows = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[start].view(KIND).ravel()
    order = np.argsort(windows)
    windows = windows[order]
    fresh = np.concatenate(([True], windows[1:] != windows[:-1]))
    ids = np.minimum.reduceat(np.repeat(lows, count)[order], np.flatnonzero(fresh))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return Level(windows[fresh], ids), place, first


def search(generations: list[tuple[list[bytes], np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    family, out = Family(), []
    for contexts, lows in generations:
        level, place, first = suffix_array(contexts, lows)
        out.append((family.add(level)[place], first))
    return out


def report(docs: DataFrame) -> DataFrame:
    return digest(remove(docs, Bytes, search), "n_bytes")
