"""Substring removal with one compressed FM-index per shard.

The distinct contexts of a shard, as word numbers, are indexed by their Burrows-Wheeler transform in a wavelet
matrix. The contexts are streamed from right to left by backward search, all at once; each holds the interval of the
rows that start with its matching statistic, capped at ``WIDTH`` words: after a step to one word more, the interval
widens to all rows that agree on the first WIDTH words. Where the statistic reaches WIDTH, the interval's smallest
document id is the window's answer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import WIDTH, Words, digest, remove


class Wavelet:
    """Rank over a sequence of small numbers: one packed bit row per bit, the highest first."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.rows, self.sums, self.zeros = [], [], []
        for b in reversed(range(self.bits)):
            bit = (seq >> b & 1).astype(bool)
            raw = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(raw)] = raw
            self.rows.append(words)
            self.sums.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])))
            self.zeros.append(len(bit) - int(bit.sum()))
            seq = np.concatenate((seq[~bit], seq[bit]))
        self.base = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.sums[level][word] + np.bitwise_count(self.rows[level][word] & below)
            at = np.where(symbol >> (self.bits - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.base[symbol]


def ranks_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and for each key the number of different smaller ones."""
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
    return order, rank


class FMIndex:
    """text: word numbers from 1, contexts ended by 0; ids: the smallest document of each position."""

    def __init__(self, text: np.ndarray, ids: np.ndarray):
        n = len(text)

        def ahead(rank: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[: max(0, n - by)] = rank[by:] + 1
            return out

        rank, length, order = text.astype(np.int64), 1, None
        while length < 2 * WIDTH:
            if length <= WIDTH < 2 * length:  # the first WIDTH words, from two that overlap
                same = (rank << 32) | ahead(rank, WIDTH - length)
            order, rank = ranks_of((rank << 32) | ahead(rank, length))
            length *= 2
            if length > WIDTH:
                break
        self.n = n
        self.wavelet = Wavelet(text[order - 1], int(text.max()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))))
        head = np.concatenate(([True], same[order][1:] != same[order][:-1]))
        starts = np.flatnonzero(head)
        self.row_class = np.cumsum(head) - 1
        self.lo, self.hi = starts, np.concatenate((starts[1:], [n]))
        self.least = np.minimum.reduceat(ids[order], starts)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows that start with the symbol and then with what the rows did."""
        first = self.before[symbol]
        return first + self.wavelet.rank(symbol, lo), first + self.wavelet.rank(symbol, hi)

    def stream(self, contexts: list[np.ndarray]) -> list[np.ndarray]:
        """The smallest id of every window of every context; all contexts are in the index."""
        order = np.argsort([-len(c) for c in contexts], kind="stable")
        size = np.array([len(contexts[i]) for i in order])
        flat, first = np.concatenate([contexts[i] for i in order]), np.cumsum(size) - size
        out = [np.empty(s - WIDTH + 1, np.int64) for s in size.tolist()]
        answers = np.empty(int((size - WIDTH + 1).sum()), np.int64)
        begin = np.cumsum(size - WIDTH + 1) - (size - WIDTH + 1)
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.n)
        for t in range(int(size[0])):
            live = np.searchsorted(-size, -t, side="left")  # contexts longer than t come first
            at = size[:live] - 1 - t
            lo, hi = self.step(flat[first[:live] + at], lo[:live], hi[:live])
            if t >= WIDTH - 1:
                own = self.row_class[lo]
                lo, hi = self.lo[own], self.hi[own]
                answers[begin[:live] + at] = self.least[own]
        for k, i in enumerate(order):
            out[i] = answers[begin[k] : begin[k] + size[k] - WIDTH + 1]
        return out


def search(generations: list[tuple[list[bytes], np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One index over all generations; a window's answer is the smallest id of the whole shard."""
    numbers: dict[bytes, int] = {}
    known: dict[bytes, int] = {}
    lows: list[int] = []
    for contexts, own in generations:
        for c, low in zip(contexts, own.tolist(), strict=True):
            k = known.setdefault(c, len(lows))
            if k == len(lows):
                lows.append(low)
            else:
                lows[k] = min(lows[k], low)
    seqs = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in c.split(b" ")], np.int64) for c in known]
    stop = np.zeros(1, np.int64)
    text = np.concatenate([x for s in seqs for x in (s, stop)])
    ids = np.repeat(np.array(lows, np.int64), [len(s) + 1 for s in seqs])
    found = FMIndex(text, ids).stream(seqs)
    out = []
    for contexts, _ in generations:
        rows = [found[known[c]] for c in contexts]
        out.append((np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))))
    return out


def report(docs: DataFrame) -> DataFrame:
    return digest(remove(docs, Words, search), "n_words").drop("n_spans")
