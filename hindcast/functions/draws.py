"""Random draws that depend on a seed and a row's key only.

Row order has no meaning in a distributed table, and a retried task must draw the same numbers again, so nothing here
uses ``rand()``: every draw is a hash of (seed, key).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
# Multipliers below 2**31, so a 32-bit value times one of them stays inside a signed 64-bit integer.
MIX_STEPS = ((16, 0x7FEB352D), (15, 0x31848BAB))
MIX_LAST_SHIFT = 14
# What a row's hash moves by from one replicate to the next, before it is hashed again.
REPLICATE_STEP = 2654435


def uniform(seed: int, *keys: Column | str) -> Column:
    """A double in [0, 1) from 52 bits of the MD5 of ``seed|key|...``."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def mix32(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``out``: a 32-bit integer hash of the low 32 bits of ``value``.

    Each step is its own projection, because each uses the value before it twice; nested in one expression the tree
    would double per step.
    """
    df = df.withColumn(out, value.bitwiseAND(F.lit(MASK32)))
    for shift, factor in MIX_STEPS:
        df = df.withColumn(out, F.col(out).bitwiseXOR(F.shiftrightunsigned(out, shift)))
        df = df.withColumn(out, (F.col(out) * F.lit(factor)).bitwiseAND(F.lit(MASK32)))
    return df.withColumn(out, F.col(out).bitwiseXOR(F.shiftrightunsigned(out, MIX_LAST_SHIFT)))


def key_hash(df: DataFrame, seed: int, key: str, out: str) -> DataFrame:
    """Add ``out``: a 32-bit hash of all 64 bits of the integer column ``key``."""
    df = mix32(df, F.col(key).cast("bigint").bitwiseXOR(F.lit(seed)), out)
    high = F.shiftrightunsigned(F.col(key).cast("bigint"), 32)
    return mix32(df, F.col(out).bitwiseXOR(high), out)


def mix32_array(x: np.ndarray) -> np.ndarray:
    """``mix32`` for NumPy arrays inside tasks, as 32-bit integers."""
    x = x.astype(np.uint32)
    for shift, factor in MIX_STEPS:
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(MIX_LAST_SHIFT)
    return x


def poisson_cuts(rate: float = 1.0) -> list[int]:
    """Cumulative Poisson probabilities as 32-bit integers: a draw is the number of cuts that the hash reaches."""
    cuts, total = [], 0.0
    for k in range(13):
        total += math.exp(-rate) * rate**k / math.factorial(k)
        cuts.append(min(math.floor(total * 2**32), MASK32))
    return cuts


POISSON_CUTS = poisson_cuts()


def poisson(h: Column, cuts: Sequence[int] = POISSON_CUTS) -> Column:
    """A Poisson count from a 32-bit hash."""
    count = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        count = F.when(h < F.lit(cuts[k]), F.lit(k)).otherwise(count)
    return count


def poisson_table(cuts: Sequence[int] = POISSON_CUTS) -> np.ndarray:
    """Per upper half of a hash the Poisson count of all hashes that begin so, or 128 and more where a cut lies among them."""
    table = np.zeros(1 << 16, np.uint8)
    for cut in cuts:
        table[(cut >> 16) + 1:] += 1
    table[[cut >> 16 for cut in cuts]] |= 128
    return table


def poisson_array(h: np.ndarray, cuts: Sequence[int] = POISSON_CUTS, table: np.ndarray | None = None) -> np.ndarray:
    """``poisson`` for NumPy arrays of 32-bit hashes inside tasks; ``table`` is that of the cuts, for many calls."""
    h = np.ascontiguousarray(h, np.uint32)
    count = (poisson_table(cuts) if table is None else table).take(h >> np.uint32(16))
    near = np.flatnonzero(count >= 128)
    count.ravel()[near] = np.searchsorted(np.array(cuts, np.uint32), h.ravel()[near], "right")
    return count


COMPARED = 5  # draws up to this are told by comparisons; more is so rare that it is looked up


class MovedCounts:
    """``poisson_array(mix32_array(slot + move))`` of all pairs of slots and moves, as bytes, for many calls with the same cuts.

    Works in arrays of its own, so that they stay in the processor's cache; a result is good until the next call.
    """

    def __init__(self, cuts: Sequence[int]):
        self.cuts, self.cells = np.array(cuts, np.uint32), 0

    def __call__(self, slots: np.ndarray, moved: np.ndarray) -> np.ndarray:
        cells, shape = len(slots) * len(moved), (len(slots), len(moved))
        if cells > self.cells:
            self.cells = -(-cells // 8) * 8
            self.arrays = [np.empty(self.cells, t) for t in (np.uint32, np.uint32, np.uint8, np.uint8)]
        x, y, count, reached = (a[:cells].reshape(shape) for a in self.arrays)
        np.add(slots[:, None], moved[None, :], out=x)
        for shift, factor in MIX_STEPS:
            np.bitwise_xor(x, np.right_shift(x, np.uint32(shift), out=y), out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.bitwise_xor(x, np.right_shift(x, np.uint32(MIX_LAST_SHIFT), out=y), out=x)
        np.greater_equal(x, self.cuts[0], out=count.view(bool))
        for cut in self.cuts[1:COMPARED]:
            np.add(count, np.greater_equal(x, cut, out=reached.view(bool)).view(np.uint8), out=count)
        # Where all of them are reached: eight cells at a time, since few are.
        self.arrays[3][cells:] = 0
        np.equal(count, COMPARED, out=reached.view(bool))
        words = self.arrays[3].view(np.uint64)[:-(-cells // 8)]
        some = (np.flatnonzero(words)[:, None] * 8 + np.arange(8)).ravel()
        many = some[self.arrays[3][some] != 0]
        self.arrays[2][many] = np.searchsorted(self.cuts, self.arrays[0][many], "right")
        return count
