"""Words of many texts as 64-bit hashes, and hashes of runs of words, computed on whole arrays.

A word is a maximal run of bytes other than space and tab to carriage return. The quick hash of a word is a polynomial modulo
2^64 over its bytes: equal words have equal hashes, but texts can be made to collide, so it only serves to find candidates.
The sure hashes are two halves of BLAKE2b, worked out once per different word. Runs of words are polynomials over the hashes of
their words, so the hash of a run comes from a running sum; equal runs have equal hashes in every process.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from hashlib import blake2b

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


BLOCK = 1 << 20  # bytes hashed at a time
_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; those of a block are kept."""
    if n <= len(_known.get(base, ())):
        return _known[base][:n]
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if n <= BLOCK + 1:
        _known[base] = out
    return out[:n]


def upto_hashes(values: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of all values before each place."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    return total


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, total: np.ndarray | None = None
               ) -> np.ndarray:
    """For each [start, end) the polynomial hash of values in it; ``total`` is ``upto_hashes`` of them, for many calls."""
    if total is None:
        total = upto_hashes(values, base)
    inverse = pow(base, -1, 2**64)
    return (total[ends] - total[starts]) * _powers(inverse, len(values) + 1)[starts]


def digest(word: bytes) -> bytes:
    """16 bytes that no one can choose words to share (BLAKE2b)."""
    return blake2b(word, digest_size=16).digest()


class Words:
    """Words of a batch of texts: quick ``hash`` of each, ``doc`` index, byte ``start`` and ``end`` in the joined texts,
    and ``first``, where each document's words begin (one entry more than documents). ``sure`` holds two hashes of the words
    for which ``make_sure`` was called."""

    def __init__(self, texts: Sequence[str | None], lower: bool = False):
        blobs = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = b" ".join(blobs) + b" "
        self.lower, self.sure = lower, None
        raw = np.frombuffer(self.bytes, np.uint8)
        sizes = np.fromiter((len(b) + 1 for b in blobs), np.int64, len(blobs))
        doc_end = np.cumsum(sizes)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.concatenate([[0], np.searchsorted(self.start, doc_end)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(blobs)), np.diff(self.first))
        table = _BYTE[_LOWER] if lower else _BYTE
        self.hash = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            # As many words as a block of bytes holds, one at least.
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + BLOCK, "right")))
            lo, hi = self.start[i], self.end[j - 1]
            own = run_hashes(table[raw[lo:hi]], self.start[i:j] - lo, self.end[i:j] - lo, _BASES[0])
            self.hash[i:j] = mix(own + (self.end[i:j] - self.start[i:j]).astype(np.uint64))
            i = j

    def make_sure(self, which: np.ndarray) -> None:
        """``sure`` hashes for the words of these numbers."""
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__  # a new word gets the next number
        data = self.bytes.lower() if self.lower else self.bytes
        own = np.fromiter((number[data[a:b]] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())), np.int64,
                          len(which))
        known = np.frombuffer(b"".join(map(digest, number)), "<u8").reshape(-1, 2).astype(np.uint64)
        self.sure = np.zeros((2, len(self.hash)), np.uint64)
        self.sure[:, which] = known[own].T

    def runs(self, length: int, which: int | None = None) -> np.ndarray:
        """A hash of the ``length`` words from each word on, by their quick hashes or one or the other sure hash; runs that
        leave a document are in ``inside`` false."""
        n = len(self.hash)
        if n < length:
            return np.zeros(0, np.uint64)
        at = np.arange(n - length + 1)
        return mix(run_hashes(mix(self.hash) if which is None else self.sure[which], at, at + length, _BASES[which or 0]))

    def inside(self, length: int) -> np.ndarray:
        """Whether the run of ``length`` words from each word on stays in one document."""
        n = len(self.hash)
        if n < length:
            return np.zeros(0, bool)
        return self.doc[: n - length + 1] == self.doc[length - 1:]
