"""Scalar expressions: dates, ages, labels, flags, grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 8.64e10

# Lab flag texts and their scores.
FLAG_SCORES = {"Low Panic": 0.25, "Low": 0.5, "High": 0.75, "High Panic": 1.0}


def _col(c: Column | str) -> Column:
    return F.col(quoted(c)) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """A column name as one identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def lenient_date(c: Column | str) -> Column:
    """Text to date; text that is no date becomes NULL."""
    return F.try_to_date(_col(c).cast("string"))


def age_years(birth: Column | str, at: Column | str) -> Column:
    """Whole years of 365 days, rounded down (also below zero)."""
    return F.floor(F.datediff(F.to_date(_col(at)), F.to_date(_col(birth))) / F.lit(365)).cast("int")


def survival_days(death: Column | str, appt: Column | str) -> Column:
    """Days from appointment to death, with fractions; infinite when there is none or it came before."""
    micros = lambda c: F.unix_micros(_col(c).cast("timestamp"))
    days = (micros(death) - micros(appt)) / F.lit(MICROS_PER_DAY)
    return F.when(days.isNull() | (days < 0), F.lit(float("inf"))).otherwise(days)


def label_horizon(death: Column | str, appt: Column | str, days: int = 360) -> Column:
    """1 when death comes less than ``days`` after the appointment (or before it), else 0."""
    micros = lambda c: F.unix_micros(_col(c).cast("timestamp"))
    return F.coalesce((micros(death) - micros(appt)) < F.lit(int(days * MICROS_PER_DAY)), F.lit(False)).cast("int")


def compound_growth(value: Column | str, rate: Column | str, periods: Column | str) -> Column:
    return _col(value) * F.pow(F.lit(1.0) + _col(rate), _col(periods))


def sex_indicator(sex_code: Column | str) -> Column:
    """Codes 1 and 2 to 0 and 1."""
    return (_col(sex_code) - F.lit(1)).cast("int")


def flag_score(c: Column | str, scores: Mapping[str, float] = FLAG_SCORES, strict: bool = False) -> Column:
    """Flag text to its score; missing is 0.

    Text outside the table is 0 too, or fails the job with ``strict``.
    """
    c = _col(c)
    branches = [(c == F.lit(text), F.lit(float(score))) for text, score in scores.items()]
    out = F.when(*branches[0])
    for branch in branches[1:]:
        out = out.when(*branch)
    if strict:
        out = out.when(c.isNotNull() & (c != F.lit("0")),
                       F.raise_error(F.concat(F.lit("unknown flag: "), c)).cast("double"))
    return out.otherwise(F.lit(0.0))


def recode_flags(df: DataFrame, scores: Mapping[str, float] = FLAG_SCORES, suffix: str = "FLAG",
                 strict: bool = False) -> DataFrame:
    """Replace every column whose name ends with ``suffix`` by its score, in one projection."""
    return df.select(*[
        flag_score(c, scores, strict).alias(c) if c.endswith(suffix) else F.col(quoted(c)) for c in df.columns])


def grid_point(i: Column, lo: Column, hi: Column, n: int) -> Column:
    """Point ``i`` of ``n`` evenly spaced points; the last one is exactly ``hi``."""
    return F.when(i >= F.lit(n - 1), hi).otherwise(lo + i * ((hi - lo) / F.lit(float(n - 1))))


def grid_rank(v: Column, lo: Column, hi: Column, n: int, inclusive: bool) -> Column:
    """How many of ``n`` evenly spaced points lie below ``v`` (``inclusive``: at or below).

    Division gives the place up to rounding; the neighbours are then compared as ``grid_point`` computes them, so the
    answer is the one that comparing with all ``n`` points would give.
    """
    step = (hi - lo) / F.lit(float(n - 1))
    guess = F.coalesce(F.floor(F.try_divide(v - lo, step)), F.lit(0))
    guess = F.least(F.greatest(guess, F.lit(-1)), F.lit(n)).cast("int")
    below = (lambda p: p <= v) if inclusive else (lambda p: p < v)
    count = F.greatest(guess - F.lit(1), F.lit(0))
    for shift in (-1, 0, 1):
        i = guess + F.lit(shift)
        in_grid = (i >= F.lit(0)) & (i < F.lit(n)) & below(grid_point(i, lo, hi, n))
        count = count + F.when(in_grid, F.lit(1)).otherwise(F.lit(0))
    flat = F.when(below(lo), F.lit(n)).otherwise(F.lit(0))
    return F.when(step == F.lit(0.0), flat).otherwise(F.least(count, F.lit(n))).cast("int")


def list_rank(v: Column, points: Sequence[float], inclusive: bool) -> Column:
    """How many of a short list of points lie below ``v`` (``inclusive``: at or below)."""
    total = F.lit(0)
    for p in points:
        hit = (v >= F.lit(float(p))) if inclusive else (v > F.lit(float(p)))
        total = total + F.when(hit, F.lit(1)).otherwise(F.lit(0))
    return total
