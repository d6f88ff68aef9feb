"""A bidirectional FM-index over the word ids of one shard, and the n-grams that its intervals enumerate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes by their first `depth` symbols at least; past the end is least.

    As many symbols as fit into 63 bits are sorted at once, from there ranks double.
    """
    n = len(ids)
    bits = max(1, int(ids.max(initial=0) + 1).bit_length())
    done = max(1, min(depth, 63 // bits))
    key = np.zeros(n, np.int64)
    for k in range(done):
        key <<= bits
        key[: max(n - k, 0)] += ids[k:] + 1
    order = np.argsort(key, kind="stable")
    while done < depth:
        rank = _ranks(key[order], order)
        key = rank * (n + 1)
        key[: max(n - done, 0)] += rank[done:] + 1
        order = np.argsort(key, kind="stable")
        done *= 2
    return order.astype(np.int32 if n < 1 << 31 else np.int64)


def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.zeros(len(order), np.int64)
    if len(order):
        rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
    return rank


def _by_symbol(symbols: np.ndarray) -> np.ndarray:
    """Stable order of non-negative ids, 16 bits at a time (which numpy sorts by counting)."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while int(symbols.max(initial=0)) >> shift:
        order = order[np.argsort((symbols[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


@dataclass
class Grams:
    """N-grams of one length: their words (a row each), and the intervals of the index of the text (`lo`) and of the text reversed (`rlo`)."""

    words: np.ndarray
    lo: np.ndarray
    rlo: np.ndarray
    count: np.ndarray


class FmIndex:
    """The Burrows-Wheeler transforms of a text of word ids and of its reverse, 0 being what no n-gram crosses.

    Order by the first `depth` symbols is enough for n-grams of up to `depth` words. An n-gram is a pair of intervals, one
    in each transform, of the same length; a step to the right or left refines both at once.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        self.depth = depth
        closed = np.concatenate([[0], ids, [0]]).astype(np.int32 if max(ids.max(initial=0), len(ids)) < 1 << 30 else np.int64)
        self.bwt, self.map = self._transform(closed)
        self.rbwt, self.rmap = self._transform(closed[::-1])
        self.starts = np.append(0, np.cumsum(np.bincount(closed)))

    def _transform(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol before each suffix in order (0 before the first), and where that suffix one longer stands."""
        order = suffix_order(text, self.depth)
        bwt = np.where(order > 0, text[order - 1], 0).astype(text.dtype)
        where = np.empty(len(bwt), order.dtype)
        where[_by_symbol(bwt)] = np.arange(len(bwt), dtype=order.dtype)
        return bwt, where

    def words(self) -> Grams:
        """Every word of the text."""
        count = np.diff(self.starts)
        there = np.flatnonzero(count > 0)
        there = there[there > 0]
        lo = self.starts[there]
        return Grams(there[:, None], lo, lo.copy(), count[there])

    def right(self, grams: Grams) -> Grams:
        """The grams with one word more behind them."""
        of, word, first, count, less = self._steps(self.rbwt, grams.rlo, grams.count)
        return Grams(np.column_stack([grams.words[of], word]), grams.lo[of] + less, self.rmap[first], count)

    def left(self, grams: Grams) -> Grams:
        """The grams with one word more before them."""
        of, word, first, count, less = self._steps(self.bwt, grams.lo, grams.count)
        return Grams(np.column_stack([word, grams.words[of]]), self.map[first], grams.rlo[of] + less, count)

    @staticmethod
    def _steps(bwt: np.ndarray, lo: np.ndarray, count: np.ndarray):
        """For each interval and each symbol in it: (interval, symbol, first row of the symbol, its rows, rows of lesser symbols)."""
        total = int(count.sum())
        if total == 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        of = np.repeat(np.arange(len(lo), dtype=np.int32 if len(lo) < 1 << 31 else np.int64), count)
        begin = np.cumsum(count) - count
        rows = (np.arange(total) + np.repeat(lo - begin, count)).astype(bwt.dtype)
        key = of * np.int64(int(bwt.max()) + 1) + bwt[rows]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        at = order[heads]
        sizes = np.diff(np.append(heads, total))
        less = heads - begin[of[at]]
        symbol = bwt[rows[at]]
        real = symbol > 0
        return of[at][real], symbol[real], rows[at][real], sizes[real], less[real]

    def grams(self, shortest: int, longest: int) -> Iterator[Grams]:
        """All n-grams of `shortest` to `longest` words, by steps to the right and to the left in turn."""
        held = self.words()
        for length in range(1, longest + 1):
            if length >= shortest:
                yield held
            if length < longest:
                held = self.right(held) if length % 2 else self.left(held)
