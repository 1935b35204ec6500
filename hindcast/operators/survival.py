"""Calibration and survival by risk group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.beta import beta_interval
from hindcast.functions.scalars import grid_point, grid_rank, list_rank


def calibration(scores: DataFrame, n_bins: int = 10, by: Sequence[str] = ("model",),
                include_max: bool = False) -> DataFrame:
    """Positives and rows per equal-width bin [lo, hi) from the lowest to the highest score.

    The highest score lies in no bin, unless ``include_max`` puts it in the last one. All bins appear.
    """
    by = list(by)
    cells = scores.groupBy(*by, "pred").agg(F.sum(F.col("label").cast("bigint")).alias("positives"),
                                            F.count(F.lit(1)).alias("n"))
    spans = cells.groupBy(*by).agg(F.min("pred").alias("lo"), F.max("pred").alias("hi"))
    place = grid_rank(F.col("pred"), F.col("lo"), F.col("hi"), n_bins + 1, True) - 1
    if include_max:
        place = F.least(place, F.lit(n_bins - 1))
    counts = cells.join(spans, by).withColumn("bin", place).groupBy(*by, "bin") \
        .agg(F.sum("positives").alias("positives"), F.sum("n").alias("n"))
    lo, hi = F.col("lo"), F.col("hi")
    first = lambda i: grid_point(i, lo, hi, n_bins + 1)
    half = (first(F.lit(1)) - first(F.lit(0))) / F.lit(2.0)
    bins = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return bins.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (first(F.col("bin")) + half).alias("center"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("positives", "n")],
    ).withColumn("fraction", F.try_divide("positives", "n"))


def with_interval(counts: DataFrame, num: str, denom: str, level: float = 0.95) -> DataFrame:
    """Add ``lower`` and ``upper``. For aggregated tables: a few numbers per group, never rows of data."""
    lower, upper = beta_interval(F.col(num), F.col(denom), level)
    return counts.withColumns({"lower": lower, "upper": upper})


def empirical_survival(scores: DataFrame, cuts: Sequence[float], max_days: int = 365, by: Sequence[str] = ("model",),
                       survival: str = "surv") -> DataFrame:
    """Per cut, risk group (score above the cut: High, else Low) and day 0..max_days-1: rows surviving past the day.

    Infinite survival counts as surviving: an empirical share, without censoring. Rows are counted once by score
    band between cuts and by last day survived; all curves are then sums over at most (cuts + 1) * (days + 1) counts.
    """
    by, cuts = list(by), sorted(cuts)
    last = F.least(F.ceil(F.least(F.col(survival), F.lit(float(max_days)))), F.lit(max_days)).cast("int")
    # Survival > day holds exactly when ceil(survival) > day.
    cells = scores.withColumn("_band", list_rank(F.col("pred"), cuts, False)).withColumn("_last", last) \
        .groupBy(*by, "_band", "_last").agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("cut"),
                 F.when(F.col("_band") > i, F.lit("High risk")).otherwise(F.lit("Low risk")).alias("risk"))
        for i, c in enumerate(cuts)])).alias("s")
    counts = cells.select(*by, sides, "_last", "n").groupBy(*by, "s.cut", "s.risk", "_last").agg(F.sum("n").alias("n"))
    groups = counts.select(*by, "cut", "risk").distinct()
    every = groups.select(*by, "cut", "risk", F.explode(F.sequence(F.lit(0), F.lit(max_days))).alias("_last"),
                          F.lit(0).cast("bigint").alias("n"))
    counts = counts.unionByName(every).groupBy(*by, "cut", "risk", "_last").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "cut", "risk")
    after = group.orderBy(F.desc("_last")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, "cut")
    out = counts.select(
        *by, "cut", "risk", F.col("_last").alias("day"), F.coalesce(F.sum("n").over(after), F.lit(0)).alias("n_survived"),
        F.sum("n").over(group).alias("n_group"), F.sum("n").over(whole).alias("_all"))
    return out.where(F.col("day") < max_days).withColumns({
        "survival": F.try_divide("n_survived", "n_group"), "group_share": F.try_divide("n_group", "_all")}).drop("_all")
