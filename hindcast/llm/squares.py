"""Online detection of squares and runs in a growing sequence of numbers.

Dyadic square catching: every completed block of s = 2^k numbers that starts at a multiple of s keeps a catcher, which waits
for squares with a period of 2s - 1 to 4s - 2 whose first half holds the block. Each appended number closes a suffix of s
numbers, and that suffix is compared with the two blocks whose catchers wait for it. A suffix equal to its block is a
stretch on which the sequence equals itself one period later; the stretch is extended to the left once, and to the right as
numbers come. From a stretch of one period on, each further number ends a square, and squares side by side make up a run.

With runs of LEAST numbers or more, blocks of two wait for periods 1 to 6: the stretch of such a run has six numbers, so it
holds an aligned block of two. Stretches of a period q >= 2s - 1 hold an aligned block of s.

Suffixes are compared by a hash made by doubling. Whatever is reported is compared number by number; should a hash have
lied, the sequence is read again under other hashes.
"""

from __future__ import annotations

import numpy as np

from hindcast.llm.wordhash import mix

LEAST = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _periods(level: int) -> tuple[int, int]:
    size = 1 << level
    return (1 if level == 1 else 2 * size - 1), 4 * size - 2


class Squares:
    """All runs with ``least`` numbers or more and at least two periods, none longer than ``longest``.

    ``append`` takes any count of numbers at a time; the runs do not depend on how the sequence is cut.
    """

    def __init__(self, longest: int, least: int = LEAST):
        if least < LEAST:
            raise ValueError(f"least must be {LEAST} or more")
        self.least, self.longest, self.salt = least, longest, 0
        self.levels = [1]
        while _periods(self.levels[-1] + 1)[0] <= longest // 2:
            self.levels.append(self.levels[-1] + 1)
        self.words = np.zeros(0, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.hashes = [np.zeros(0, np.uint64) for _ in range(self.levels[-1] + 1)]
        self.seen = 0
        self.open = np.zeros((2, 0), np.int64)  # (start, period) of stretches that reach the end
        self.closed: list[np.ndarray] = []  # (start, end, period)

    def append(self, words: np.ndarray) -> np.ndarray:
        """(start, period, first end, last end) of the squares that these numbers complete, by stretch; a stretch of a
        period also holds the squares of its multiples, as stretches of their own."""
        self.words = np.concatenate([self.words, np.asarray(words, np.int64)])
        old, new = self.seen, len(self.words)
        self._hash(new)
        self.seen = new
        start, period = self._caught(old, new)
        start = np.concatenate([self.open[0], start])
        period = np.concatenate([self.open[1], period])
        end = self._extend(np.maximum(start + period, old), period)
        stretch = np.unique(np.stack([start, end, period]), axis=1) if len(start) else np.zeros((3, 0), np.int64)
        start, end, period = stretch
        at_end = end == new
        self.open = np.stack([start[at_end], period[at_end]])
        whole = ~at_end & self._whole(start, end, period)
        self.closed.append(stretch[:, whole])
        first = np.maximum(start + 2 * period, old + 1)
        fresh = first <= end
        return np.stack([start, period, first, end])[:, fresh]

    def runs(self) -> np.ndarray:
        """(start, length, period) of the runs of what was appended so far, by start and period."""
        while True:
            end = np.full(self.open.shape[1], self.seen)
            last = np.stack([self.open[0], end, self.open[1]])
            found = np.concatenate([*self.closed, last[:, self._whole(*last)]], axis=1)
            # A stretch of a multiple of the period is the same stretch: the smallest stays.
            order = np.lexsort((found[2], found[1], found[0]))
            found = found[:, order]
            new = np.ones(found.shape[1], bool)
            new[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
            found = found[:, new]
            if self._verified(found):
                start, end, period = found[:, np.lexsort((found[2], found[0]))]
                return np.stack([start, end - start, period])
            words, self.words = self.words, np.zeros(0, np.int64)
            self.salt += 1
            self._forget()
            self.append(words)

    def _whole(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
        return end - start >= np.maximum(self.least, 2 * period)

    def _verified(self, found: np.ndarray) -> bool:
        w = self.words
        for a, b, q in found.T.tolist():
            if not np.array_equal(w[a:b - q], w[a + q:b]) or (a and w[a - 1] == w[a - 1 + q]) \
                    or (b < len(w) and w[b] == w[b - q]):
                return False
        return True

    def _hash(self, new: int) -> None:
        """Hashes of the runs of 2^k numbers that the sequence holds now, from each start."""
        own = self.words[self.seen:new].astype(np.uint64) + np.uint64(1 + self.salt)
        self.hashes[0] = np.concatenate([self.hashes[0], mix(own * _ODD)])
        for k in range(1, len(self.hashes)):
            half, below, had = 1 << (k - 1), self.hashes[k - 1], len(self.hashes[k])
            count = max(0, new - 2 * half + 1)
            if count > had:
                value = below[had:count] * _ODD
                value ^= value >> np.uint64(29)
                value += below[had + half:count + half]
                value *= np.uint64(0xD6E8FEB86659FD93)
                value ^= value >> np.uint64(32)
                self.hashes[k] = np.concatenate([self.hashes[k], value])

    def _caught(self, old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) of the stretches of suffixes that equal a waiting block, the block's left extension done."""
        starts, periods = [], []
        for level in self.levels:
            size, (low, high) = 1 << level, _periods(level)
            h = self.hashes[level]
            at = np.arange(max(0, old + 1 - size), new - size + 1)
            if not len(at):
                continue
            block = (at - low) // size * size
            caught = []
            while True:
                waits = (block >= 0) & (at - block <= high)
                if not waits.any():
                    break
                hit = np.flatnonzero(h[np.where(waits, block, 0)] == h[at])
                hit = hit[waits[hit]]
                caught.append(np.stack([at[hit] - block[hit], block[hit]]))
                block = block - size
            period, block = np.concatenate(caught, axis=1) if caught else np.zeros((2, 0), np.int64)
            # Blocks side by side that are caught with one period lie on one stretch: the first stands for all.
            order = np.lexsort((block, period))
            period, block = period[order], block[order]
            head = np.ones(len(block), bool)
            head[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + size)
            starts.append(block[head])
            periods.append(period[head])
        start, period = np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*periods, np.zeros(0, np.int64)])
        return start - self._common_before(start, start + period), period

    def _extend(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Where the stretches end that hold up to ``at``."""
        at = at.copy()
        top = len(self.hashes) - 1
        going = np.arange(len(at))
        for level in [top, *range(top, -1, -1)]:
            size, h = 1 << level, self.hashes[level]
            own = going
            while len(own):
                own = own[at[own] + size <= self.seen]
                own = own[h[at[own]] == h[at[own] - period[own]]]
                at[own] += size
                if level < top:
                    break
        return at

    def _common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers before i equal those before j > i."""
        back = np.zeros(len(i), np.int64)
        top = len(self.hashes) - 1
        for level in [top, *range(top, -1, -1)]:
            size, h = 1 << level, self.hashes[level]
            own = np.arange(len(i))
            while len(own):
                own = own[i[own] - back[own] >= size]
                own = own[h[i[own] - back[own] - size] == h[j[own] - back[own] - size]]
                back[own] += size
                if level < top:
                    break
        return back
