"""Repeats of SPAN bytes in a collection of byte strings, by its Burrows-Wheeler transform and common prefixes.

Column-wise construction for many documents: the strings are read from their ends, and each round inserts one symbol of
each, which adds one suffix per string to the sorted collection. A suffix that follows symbol c and starts at place p of the
sorted list goes to the place of (c, p) among all (symbol, place) pairs, which is what the transform tells. Its common prefix
with its neighbour is one symbol more than that of the two suffixes behind the symbol, read from the prefixes so
far. Every round reads and writes the lists once, from front to end, as it would sequential files.

A symbol is a run of WIDE bytes. The string of each of the WIDE phases of a piece is a document of its own, so that suffixes
start at every byte, SPAN bytes are SPAN / WIDE symbols, and there are WIDE times fewer rounds than with single bytes.
"""

from __future__ import annotations

import numpy as np

from hindcast.llm.wordhash import mix

SPAN, WIDE = 100, 20
DEPTH = SPAN // WIDE


def symbol_names(data: np.ndarray, at: np.ndarray, salt: int = 0) -> np.ndarray:
    """Numbers from 0 for the WIDE bytes from each place on: equal if and only if the bytes are equal.

    Sorted by a hash; places with equal hashes are compared byte by byte, and under another salt should one have lied.
    """
    count = len(data) - WIDE + 1
    h = np.zeros(count, np.uint64)
    for lo in range(0, WIDE, 8):
        word = np.zeros(count, np.uint64)
        for i in range(lo, min(lo + 8, WIDE)):
            word <<= np.uint64(8)
            word |= data[i:count + i]
        word += h
        word += np.uint64(1 + salt)
        h = mix(word)
    h = h[at]
    order = np.argsort(h)
    ranked = h[order]
    same = ranked[1:] == ranked[:-1]
    pairs = np.flatnonzero(same)
    views = np.lib.stride_tricks.sliding_window_view(data, WIDE)
    for lo in range(0, len(pairs), 1 << 16):
        own = pairs[lo:lo + (1 << 16)]
        if (views[at[order[own]]] != views[at[order[own + 1]]]).any():
            return symbol_names(data, at, salt + 1)
    names = np.empty(len(at), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)]) if len(at) else []
    return names


class Collection:
    """Sorted suffixes of documents that grow to the left: owners, common prefixes (up to DEPTH) and symbol places."""

    def __init__(self, documents: int):
        self.owner = np.arange(documents)  # of each place: the document whose suffix stands there
        self.left = np.zeros(documents, np.int64)  # symbols of that suffix
        self.common = np.zeros(documents, np.int8)  # with the place before
        self.keys = np.zeros(0, np.int64)  # (symbol, place), sorted: the transform, read symbol by symbol
        self.place = np.arange(documents)  # of each document's longest suffix
        self.documents = documents

    def insert(self, who: np.ndarray, symbols: np.ndarray) -> None:
        """One more symbol to the left of the documents ``who``."""
        size = len(self.owner)
        keys = (symbols << 32) | self.place[who]
        order = np.argsort(keys)
        who, keys = who[order], keys[order]
        before = np.searchsorted(self.keys, keys)
        # Among the pairs of before and of this round: their suffixes stand behind the empty ones, in this order.
        rank = before + np.arange(len(keys))
        merged = np.empty(len(self.keys) + len(keys), np.int64)
        fresh = np.zeros(len(merged), bool)
        fresh[rank] = True
        merged[fresh], merged[~fresh] = keys, self.keys
        common = self._prefixes(merged, rank)
        at = self.documents + rank
        new = np.zeros(size + len(keys), bool)
        new[at] = True
        target = np.flatnonzero(~new)  # where old suffixes stand now
        for name, value in (("owner", who), ("left", self.left[self.place[who]] + 1)):
            old = getattr(self, name)
            out = np.empty(len(new), old.dtype)
            out[new], out[~new] = value, old
            setattr(self, name, out)
        old_common, self.common = self.common, np.empty(len(new), np.int8)
        self.common[~new] = old_common
        self.common[at] = common[0]
        follows = at + 1 < len(new)
        self.common[at[follows] + 1] = common[1][follows]
        self.keys = (merged >> 32 << 32) | target[merged & 0xFFFFFFFF]
        self.place = target[self.place]
        self.place[who] = at

    def _prefixes(self, merged: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common prefixes of the pairs at ``rank`` with the pair before and of the pair after with them."""
        symbol, place = merged >> 32, merged & 0xFFFFFFFF

        def between(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = (i >= 0) & (j < len(merged))
            i, j = np.where(ok, i, 0), np.where(ok, j, 0)
            ok &= symbol[i] == symbol[j]
            out = np.zeros(len(i), np.int8)
            one, two = place[i[ok]], place[j[ok]]
            depth = np.ones(len(one), np.int8)
            for borders in self._borders():
                depth += borders[one] == borders[two]
            out[ok] = depth
            return out

        return between(rank - 1, rank), between(rank, rank + 1)

    def _borders(self) -> list[np.ndarray]:
        """For each depth below DEPTH the number of the class of suffixes that agree on so many symbols."""
        if getattr(self, "_held", (None,))[0] is not self.common:
            self._held = (self.common, [np.cumsum(self.common < d, dtype=np.int32) for d in range(1, DEPTH)])
        return self._held[1]


def first_spans(pieces: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Per piece, for each start of SPAN bytes, whether no piece has the same bytes at a smaller position.

    ``rank[i]`` is the position of the piece's first byte; positions of different documents lie apart.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces) + bytes(WIDE), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    # A document per piece and phase; its symbols are counted from its end.
    phases = np.minimum(WIDE, np.maximum(sizes - WIDE + 1, 0))
    piece = np.repeat(np.arange(len(pieces)), phases)
    phase = np.arange(len(piece)) - np.repeat(np.cumsum(phases) - phases, phases)
    length = (sizes[piece] - phase) // WIDE
    inner = np.ones(len(data), bool)
    for i in range(WIDE - 1):
        # Symbols that would cross a piece's end are never read.
        inner[np.maximum(begin[1:] - 1 - i, 0)] = False
    inner[begin[-1]:] = False
    at = np.flatnonzero(inner)
    names = np.zeros(len(data), np.int64)
    names[at] = symbol_names(data, at)
    books = Collection(len(piece))
    start = begin[:-1][piece] + phase
    active = np.arange(len(piece))
    for step in range(1, int(length.max(initial=0)) + 1):
        active = active[length[active] >= step]
        books.insert(active, names[start[active] + (length[active] - step) * WIDE])
    # Suffixes in their order; from one that agrees on less than DEPTH symbols with the one before a new class begins.
    doc, left = books.owner, books.left
    offset = phase[doc] + (length[doc] - left) * WIDE
    whole = (left >= DEPTH) & (offset + SPAN <= sizes[piece[doc]])
    position = np.where(whole, rank[piece[doc]] + offset, np.iinfo(np.int64).max)
    first = np.zeros(begin[-1], bool)
    if len(doc):
        heads = np.flatnonzero(np.concatenate([[True], books.common[1:] < DEPTH]))
        least = np.repeat(np.minimum.reduceat(position, heads), np.diff(np.append(heads, len(doc))))
        own = whole & (position == least)
        first[begin[:-1][piece[doc[own]]] + offset[own]] = True
    return [first[a:max(a, b - SPAN + 1)] for a, b in zip(begin[:-1], begin[1:])]
