"""Counting in how many of many windows each vector of a segment stands, 64 vectors to a machine word.

A window is a stretch of ranks of one sorted array. For every array there is a
bit row for each of some boundaries: the vectors that rank below it. A window
between two boundaries is the difference of two bit rows, and the windows of
many queries are added up as binary counters whose digits are bit rows.
"""

from __future__ import annotations

import numpy as np

#: Boundaries between which a window may end, for each array.
BOUNDARIES = 128


class Arrays:
    """The sorted arrays of a segment: ``projected`` has a row for each vector and a column for each array, ``rank`` its places in them."""

    def __init__(self, projected: np.ndarray, rank: np.ndarray, boundaries: int = BOUNDARIES):
        n, self.arrays = projected.shape
        self.n, self.words = n, -(-n // 64)
        steps = min(boundaries, n)
        ends = (np.arange(steps + 1) * n) // max(1, steps)
        self.below = np.zeros((self.arrays, steps + 1, self.words), np.uint64)
        self.values = np.empty((self.arrays, steps + 1))
        for h in range(self.arrays):
            bits = np.packbits(rank[:, h][None, :] < ends[:, None], axis=1, bitorder="little")
            self.below[h].view(np.uint8)[:, : bits.shape[1]] = bits
            order = np.empty(n, np.int32)
            order[rank[:, h]] = np.arange(n, dtype=np.int32)
            self.values[h, :-1] = projected[order[ends[:-1]], h]
            self.values[h, -1] = np.inf

    def windows(self, centres: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last boundary of the windows centre - half to centre + half, which they reach or pass; a row for each array."""
        low, high = np.empty((self.arrays, len(centres)), np.int32), np.empty((self.arrays, len(centres)), np.int32)
        last = self.values.shape[1] - 1
        for h in range(self.arrays):
            low[h] = np.maximum(np.searchsorted(self.values[h], centres[:, h] - half, "left") - 1, 0)
            high[h] = np.minimum(np.searchsorted(self.values[h], centres[:, h] + half, "right"), last)
        return low, high

    def counters(self, queries: int) -> np.ndarray:
        """Binary digits of the counts, lowest first."""
        return np.zeros((self.arrays.bit_length(), queries, self.words), np.uint64)

    def add(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray, old: tuple[np.ndarray, np.ndarray] | None) -> None:
        """Count the vectors that the windows hold, but not those that the ``old`` windows held."""
        held: list[list[np.ndarray]] = [[] for _ in range(len(counts) + 1)]
        for h in range(self.arrays):
            below = self.below[h]
            new = below[high[h]] & ~below[low[h]]
            if old is not None:
                new &= ~(below[old[1][h]] & ~below[old[0][h]])
            held[0].append(new)
            # Two numbers of a digit and the counter's own make one of that digit and one of the next.
            for digit in range(len(counts)):
                if len(held[digit]) < 2:
                    break
                a, b = held[digit]
                held[digit] = []
                c = counts[digit]
                either = a ^ b
                held[digit + 1].append((a & b) | (c & either))
                c ^= either
        for digit in range(len(counts)):
            for carry in held[digit]:
                for up in range(digit, len(counts)):
                    both = counts[up] & carry
                    counts[up] ^= carry
                    carry = both

    def reached(self, counts: np.ndarray, least: int) -> np.ndarray:
        """Bit rows of the vectors whose count is ``least`` or more."""
        over = np.zeros(counts.shape[1:], np.uint64)
        equal = np.full(counts.shape[1:], ~np.uint64(0))
        for digit in range(len(counts) - 1, -1, -1):
            if least >> digit & 1:
                equal &= counts[digit]
            else:
                over |= equal & counts[digit]
                equal &= ~counts[digit]
        out = over | equal
        if self.n % 64:
            out[:, -1] &= np.uint64((1 << self.n % 64) - 1)
        return out

    def members(self, row: np.ndarray) -> np.ndarray:
        """Places of the vectors of a bit row."""
        return np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little", count=self.n))


def ranks(projected: np.ndarray) -> np.ndarray:
    """Place of each vector in each sorted array."""
    order = np.argsort(projected, axis=0, kind="stable")
    out = np.empty(projected.shape, np.int32)
    np.put_along_axis(out, order, np.arange(len(projected), dtype=np.int32)[:, None], axis=0)
    return out


def candidates(arrays: Arrays, centres: np.ndarray, least: int, wanted: int, start: float, factor: float) -> list[np.ndarray]:
    """For each query the vectors in ``least`` windows or more, once ``wanted`` are or all windows hold everything."""
    out: list[np.ndarray] = [np.empty(0, int)] * len(centres)
    left = np.arange(len(centres))
    counts, old, half = arrays.counters(len(centres)), None, start
    while len(left):
        low, high = arrays.windows(centres[left], np.full(len(left), half))
        arrays.add(counts, low, high, old)
        over = arrays.reached(counts, least)
        whole = (low == 0).all(axis=0) & (high == arrays.values.shape[1] - 1).all(axis=0)
        done = (np.bitwise_count(over).sum(axis=1) >= wanted) | whole
        for i in np.flatnonzero(done).tolist():
            out[left[i]] = arrays.members(over[i])
        stay = ~done
        left, counts, old, half = left[stay], counts[:, stay].copy(), (low[:, stay], high[:, stay]), half * factor
    return out
