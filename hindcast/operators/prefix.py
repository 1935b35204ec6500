"""Sorted computations without one big sorted group: running sums, ranks, exact quantiles.

A window over one group puts all its rows in one task. Here the value axis is cut into ranges first; each range is its
own window group, and what lies in the ranges before it comes from a table with one row per group and range. The cut
points are approximate quantiles of the data itself, so that no range holds much more than its share of the rows. They
only steer the work: the results are exact for any cut points.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.draws import uniform
from hindcast.functions.scalars import quoted
from hindcast.session import shuffle_width


def cut_points(df: DataFrame, value: str, ranges: int, needed: Sequence[str] = ()) -> Column:
    """A one-value subquery: approximate quantiles of ``value``, and every stride-th of them as a coarse list.

    ``needed`` names columns that the main computation reads too. Reading them here as well keeps both plans alike,
    so that Spark reuses one shuffle of ``df`` for both.
    """
    for c in needed:
        df = df.where(F.col(c).isNotNull())
    probs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    points = F.percentile_approx(F.col(value).cast("double"), probs, F.lit(10 * ranges)).alias("p")
    coarse = F.filter("p", lambda _, i: (i + 1) % _stride(ranges) == 0)
    none = F.array().cast("array<double>")
    return df.select(points).select(F.coalesce("p", none).alias("p")) \
        .select(F.struct("p", coarse.alias("coarse")).alias("s")).scalar()


def _stride(ranges: int) -> int:
    return max(1, math.isqrt(ranges))


def count_below(points: Column, size: int, value: Column, start: Column | None = None) -> Column:
    """How many of the ``size`` rising entries of an array (from ``start`` on) lie below ``value``.

    A tree of comparisons, so a row costs log2(size) of them inside generated code. Entries past the end count as not
    below.
    """
    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        at = F.lit(mid) if start is None else start + mid
        return F.when(F.get(points, at) < value, between(mid + 1, hi)).otherwise(between(lo, mid))

    return between(0, size)


def with_range(df: DataFrame, points: Column, value: str, ranges: int, out: str = "_range") -> DataFrame:
    """Add ``out``: the number of cut points below ``value``, a range number that rises with the value.

    Coarse points first, then the one stretch of fine points that is left.
    """
    stride, v = _stride(ranges), F.col(value).cast("double")
    # A column first: every mention of the subquery itself would be planned on its own.
    df = df.withColumn("_points", points)
    df = df.withColumn("_skip", count_below(F.col("_points.coarse"), (ranges - 1) // stride, v) * stride)
    fine = count_below(F.col("_points.p"), stride, v, F.col("_skip"))
    return df.withColumn(out, F.col("_skip") + fine).drop("_skip", "_points")


def _offsets(df: DataFrame, by: Sequence[str], totals: Mapping[str, str], descending: bool) -> DataFrame:
    """Per group and range: the totals of all ranges before it. The window's group is the few ranges of one group."""
    sums = df.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(totals.values())])
    order = F.desc("_range") if descending else F.asc("_range")
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "_range", *[
        F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(totals))])


def running_sums(cells: DataFrame, value: str, sums: Mapping[str, str], by: Sequence[str] = (),
                 descending: bool = False, ranges: int | None = None, points: Column | None = None) -> DataFrame:
    """Add running sums in the order of ``value`` within each group (inclusive of the row); NULL groups are left out.

    ``cells`` has at most one row per group and value. ``sums`` maps new column names to summed columns, which are not
    NULL. ``points`` are cut points, where some cheaper table than ``cells`` has the same spread of values.
    """
    ranges = ranges or shuffle_width(cells.sparkSession)
    if points is None:
        points = cut_points(cells, value, ranges, [*by, *sums.values()])
    return _running(with_range(cells, points, value, ranges), value, sums, by, descending)


def _running(placed: DataFrame, value: str, sums: Mapping[str, str], by: Sequence[str],
             descending: bool) -> DataFrame:
    by = list(by)
    offsets = _offsets(placed, by, sums, descending)
    inner = Window.partitionBy(*by, "_range").orderBy(F.desc(value) if descending else F.asc(value)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = [F.col(quoted(c)) for c in placed.columns if c != "_range"]
    return placed.join(offsets, [*by, "_range"]).select(*kept, *[
        (F.sum(c).over(inner) + F.col(f"_o{i}")).alias(out) for i, (out, c) in enumerate(sums.items())])


def random_rank(df: DataFrame, seed: int, key: str, out: str = "rank", by: Sequence[str] = (),
                ranges: int | None = None) -> DataFrame:
    """Add ``out``: 1 to n within each group, in a random order fixed by the seed and the row's unique key.

    The random number is uniform, so equal slices of [0, 1) hold equal shares of the rows whatever the keys are.
    """
    ranges = ranges or shuffle_width(df.sparkSession)
    by = list(by)
    place = F.coalesce(F.floor(F.col("_u") * ranges).cast("int"), F.lit(0))
    drawn = df.withColumn("_u", uniform(seed, key)).withColumn("_range", place) \
        .withColumn("_one", F.lit(1).cast("bigint"))
    offsets = _offsets(drawn, by, {"n": "_one"}, False)
    inner = Window.partitionBy(*by, "_range").orderBy("_u", key)
    kept = [F.col(quoted(c)) for c in df.columns]
    return drawn.join(offsets, [*by, "_range"]).select(*kept, (F.row_number().over(inner) + F.col("_o0")).alias(out))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    ranges: int | None = None) -> DataFrame:
    """Quantiles with linear interpolation: one row per group and probability, NULLs left out.

    Counts per distinct value are ranked; only the two rows around each wanted rank go on.
    """
    by = list(by)
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    totals = cells.groupBy(*by).agg(F.sum("_n").alias("_total"))
    ranked = running_sums(cells, "_x", {"_upto": "_n"}, by, ranges=ranges)
    ranked = ranked.join(totals, by) if by else ranked.withColumn("_total", totals.select("_total").scalar())
    wanted = F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("r")) for p in probs]))
    # Ranks are counted from 0: a cell covers _upto - _n to _upto - 1.
    covers = lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto"))
    hits = ranked.withColumn("_w", wanted).withColumns({
        "_lo": F.floor(F.col("_w.r")), "_hi": F.ceil(F.col("_w.r"))}) \
        .where(covers(F.col("_lo")) | covers(F.col("_hi")))
    low, high = F.max(F.when(covers(F.col("_lo")), F.col("_x"))), F.max(F.when(covers(F.col("_hi")), F.col("_x")))
    part = F.max(F.col("_w.r") - F.col("_lo"))
    return hits.groupBy(*by, F.col("_w.p").alias("prob")).agg((low + (high - low) * part).alias("quantile"))
