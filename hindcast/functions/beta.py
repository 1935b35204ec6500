"""Credible intervals for shares, as a vectorised function for small, already aggregated tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Nodes and weights of the double exponential rule for integrals from 0 on: points from 1e-16 to 1e5 of the scale.
_STEP = 1 / 16
_at = np.arange(-3.9, 2.7, _STEP)
NODES = np.exp(math.pi / 2 * np.sinh(_at))
WEIGHTS = _STEP * math.pi / 2 * np.cosh(_at) * NODES


class _LogOdds:
    """Beta(a, b) by its log odds, counted from those of a / (a + b), where their density is largest.

    The logarithm of that density is concave for all a, b > 0. It is worked out as a difference from the largest, so counts of
    ten digits cost no precision, and its integral serves as its scale, so no gamma function is needed.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.scale = np.sqrt(1 / a + 1 / b)
        zero = np.zeros_like(a)
        self.total = self.tail(zero, -1) + self.tail(zero, 1)

    def log_density(self, u: np.ndarray) -> np.ndarray:
        """Up to a constant, for u of shape (..., rows)."""
        share, rest = self.a / (self.a + self.b), self.b / (self.a + self.b)
        return -self.a * np.log1p(rest * np.expm1(-u)) - self.b * np.log1p(share * np.expm1(u))

    def slope(self, u: np.ndarray) -> np.ndarray:
        """The derivative of ``log_density``."""
        odds = self.a / self.b * np.exp(u)
        return (self.a - self.b * odds) / (1 + odds)

    def tail(self, u: np.ndarray, side: int) -> np.ndarray:
        """The integral of the density below (-1) or above (1) u, which lies on that side of its largest value."""
        reach = 1 / (np.abs(self.slope(u)) + 1 / self.scale)
        points = u + side * NODES[:, None] * reach
        return (WEIGHTS[:, None] * np.exp(self.log_density(np.clip(points, -700, 700)))).sum(axis=0) * reach

    def below(self, u: np.ndarray) -> np.ndarray:
        outer = np.where(u < 0, self.tail(np.minimum(u, 0), -1), self.tail(np.maximum(u, 0), 1)) / self.total
        return np.where(u < 0, outer, 1 - outer)

    def above(self, u: np.ndarray) -> np.ndarray:
        outer = np.where(u > 0, self.tail(np.maximum(u, 0), 1), self.tail(np.minimum(u, 0), -1)) / self.total
        return np.where(u > 0, outer, 1 - outer)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantiles of Beta(a, b), by one method for all counts: Newton steps on the logarithm of the smaller tail, which is
    concave, with halving where a step leaves the bracket."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not len(a):
        return np.zeros(0)
    dist, lower = _LogOdds(a, b), p <= 0.5
    share = dist.below if lower else dist.above
    wanted = math.log(p if lower else 1 - p)
    lo, hi = -700 * np.minimum(dist.scale, 1), 700 * np.minimum(dist.scale, 1)
    u = np.zeros_like(a)
    for _ in range(200):
        tail = np.maximum(share(u), 1e-300)
        off = np.log(tail) - wanted
        rising = off < 0 if lower else off > 0  # the quantile lies above u
        lo, hi = np.where(rising, u, lo), np.where(rising, hi, u)
        density = np.exp(dist.log_density(u)) / dist.total
        step = u - (off if lower else -off) * tail / np.maximum(density, 1e-300)
        new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        moved = np.abs(new - u)
        u = new
        if np.all(moved <= 1e-11 * dist.scale):
            break
    else:
        raise ArithmeticError("the quantile did not converge")
    odds = a / b * np.exp(u)
    return odds / (1 + odds)


def _bound(p: float) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def run(num: pd.Series, denom: pd.Series) -> pd.Series:
        out = np.full(len(num), np.nan)
        ok = (num.notna() & denom.notna()).to_numpy()
        n, d = num.to_numpy(float)[ok], denom.to_numpy(float)[ok]
        if ok.any():
            out[ok] = beta_quantile(p, n + 1, d - n + 1)
        return pd.Series(out)

    return run


def beta_interval(num: Column, denom: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Lower and upper bound of the central interval of Beta(num + 1, denom - num + 1)."""
    tail = (1 - level) / 2
    num, denom = num.cast("double"), denom.cast("double")
    return _bound(tail)(num, denom), _bound(1 - tail)(num, denom)
