"""Importances, feature ranges, partial dependence."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import grid_point, quoted
from hindcast.operators.prefix import exact_quantiles
from hindcast.operators.sampling import background_sample
from hindcast.operators.selection import unpivot


def cumulative_importance(importances: DataFrame, name: str = "feature", score: str = "importance") -> DataFrame:
    """Importances from the highest down with their cumulative share. One row per feature, so one window group is fine."""
    upto = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), name)
    share = F.sum(score).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)) \
        / F.sum(score).over(Window.partitionBy(F.lit(0)))
    return importances.select(name, score, F.row_number().over(upto).alias("rank"), share.alias("cumulative_prop"))


def top_importance(importances: DataFrame, k: int = 10, name: str = "feature", score: str = "importance") -> DataFrame:
    return importances.orderBy(F.desc(score), name).limit(k)


def bottom_importance(importances: DataFrame, k: int = 10, name: str = "feature", score: str = "importance") -> DataFrame:
    """The ``k`` least important features, the least first."""
    return importances.orderBy(F.asc(score), name).limit(k)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def feature_ranges(df: DataFrame, features: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(feature, center, lo, hi): median and outer quantiles; mean, minimum and maximum for ``>>`` categories."""
    numeric = [f for f in features if ">>" not in f]
    category = [f for f in features if ">>" in f]
    parts = []
    if numeric:
        q = exact_quantiles(unpivot(df, numeric), "value", [low, 0.5, high], ["feature"])
        at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
        parts.append(q.groupBy("feature").agg(at(0.5).alias("center"), at(low).alias("lo"), at(high).alias("hi")))
    if category:
        parts.append(unpivot(df, category).groupBy("feature").agg(
            F.avg("value").alias("center"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def partial_dependence(model: PipelineModel, df: DataFrame, features: Sequence[str], top: Sequence[str],
                       resolution: int = 10, bootstraps: int = 100, background: bool = True, seed: int = 42,
                       key: str = "csn", aggfunc: Callable[[Column], Column] = F.avg) -> DataFrame:
    """For each pair of ``top`` features and each cell of their grid: the aggregated prediction.

    With ``background``, a cell is scored on ``bootstraps`` rows drawn from ``df`` with the two features set to the
    cell's values; without, on one row of the features' centers. The number of scored rows follows the grid, not
    the table.
    """
    ranges = {r.feature: r for r in feature_ranges(df, features).collect()}
    pairs = list(combinations_with_replacement(top, 2))
    cells, reps = resolution * resolution, bootstraps if background else 1
    grid = df.sparkSession.range(len(pairs) * cells * reps).select(
        F.col("id").alias("draw"), (F.col("id") / (cells * reps)).cast("int").alias("pair"),
        ((F.col("id") / reps).cast("bigint") % cells).cast("int").alias("pixel_index"))
    if background:
        rows = background_sample(df.select(key, *[F.col(quoted(f)) for f in features]), grid, seed, key)
    else:
        rows = grid.select("*", *[F.lit(float(ranges[f].center)).alias(f) for f in features])

    def set_to(f: str, side: int, position: Column) -> list[tuple[Column, Column]]:
        at = grid_point(position, F.lit(float(ranges[f].lo)), F.lit(float(ranges[f].hi)), resolution)
        return [(F.col("pair") == i, at) for i, p in enumerate(pairs) if p[side] == f]

    first, second = (F.col("pixel_index") / resolution).cast("int"), F.col("pixel_index") % resolution
    columns = []
    for f in features:
        value = F.col(quoted(f)).cast("double")
        # On the diagonal both positions name the same feature, and the second one is set last.
        for cond, at in set_to(f, 0, first) + set_to(f, 1, second):
            value = F.when(cond, at).otherwise(value)
        columns.append(value.alias(f))
    scored = model.transform(rows.select("pair", "pixel_index", *columns))
    names = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2")) for a, b in pairs])
    return scored.groupBy("pair", "pixel_index") \
        .agg(aggfunc(vector_to_array("probability")[1]).alias("pred")) \
        .withColumn("_p", F.element_at(names, F.col("pair") + 1)) \
        .select("_p.f1", "_p.f2", "pixel_index", "pred")
