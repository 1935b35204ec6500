"""Binary classification metrics on score tables.

A score table is long: grouping columns (model, split, subgroup, ...), ``label`` 0/1 and ``pred``. It is first counted
into cells, one row per group and distinct score, which combines on the map side; everything below reads cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import grid_point, grid_rank, list_rank, quoted
from hindcast.operators.prefix import count_below, exact_quantiles, running_sums
from hindcast.session import materialize

COUNTS = ("tn", "fp", "fn", "tp")


def score_cells(scores: DataFrame, by: Sequence[str] = ("model",), weight: str | None = None) -> DataFrame:
    """Positives and negatives per group and distinct score."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    count = lambda v: F.sum(F.when(F.col("label") == v, w).otherwise(F.lit(0).cast("bigint")))
    return scores.groupBy(*by, "pred").agg(count(1).alias("pos"), count(0).alias("neg"))


def ranked_cells(cells: DataFrame, by: Sequence[str], ranges: int | None = None,
                 points: Column | None = None) -> DataFrame:
    """Cells with running positives and negatives from the highest score down."""
    return running_sums(cells, "pred", {"cum_pos": "pos", "cum_neg": "neg"}, by, descending=True, ranges=ranges,
                        points=points)


def roc_curve(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Points (fpr, tpr, threshold), one per distinct score, and the origin with an infinite threshold."""
    by = list(by)
    cells = score_cells(scores, by)
    totals = cells.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    points = ranked_cells(cells, by).join(totals, by).select(
        *by, F.try_divide("cum_neg", "n").alias("fpr"), F.try_divide("cum_pos", "p").alias("tpr"),
        F.col("pred").alias("threshold"))
    zero = lambda c: F.when(F.col(c) > 0, F.lit(0.0))
    return points.unionByName(totals.select(
        *by, zero("n").alias("fpr"), zero("p").alias("tpr"), F.lit(float("inf")).alias("threshold")))


def rank_metrics_of_cells(cells: DataFrame, by: Sequence[str], ranges: int | None = None,
                          points: Column | None = None) -> DataFrame:
    """Per group: ``auc`` (ties count half) and ``average_precision``; NULL where a class is missing."""
    by = list(by)
    cum_pos, cum_neg = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    wins = F.col("neg") * (cum_pos - F.col("pos") / F.lit(2.0))
    precision = F.col("pos") * F.try_divide(cum_pos, cum_pos + cum_neg)
    sums = ranked_cells(cells, by, ranges, points).groupBy(*by).agg(
        F.sum(wins).alias("w"), F.sum(precision).alias("ap"),
        F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    return sums.select(*by, F.try_divide(F.col("w"), F.col("p") * F.col("n")).alias("auc"),
                       F.try_divide("ap", "p").alias("average_precision"))


def rank_metrics(scores: DataFrame, by: Sequence[str] = ("model",), ranges: int | None = None) -> DataFrame:
    return rank_metrics_of_cells(score_cells(scores, by), by, ranges)


def auc_by(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return rank_metrics(scores, by).drop("average_precision")


def average_precision_by(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return rank_metrics(scores, by).drop("auc")


def confusion(scores: DataFrame, threshold: float | Column, by: Sequence[str] = ("model",),
              inclusive: bool = True) -> DataFrame:
    """tn, fp, fn, tp per group at one cut; ``inclusive`` takes scores at the cut as positive."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = F.col("pred") >= cut if inclusive else F.col("pred") > cut
    pos = F.col("label") == 1
    return scores.groupBy(*by).agg(F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"),
                                   F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))


def _sweep(placed: DataFrame, by: Sequence[str], n: int, extra: Sequence[str] = ()) -> DataFrame:
    """Confusion counts per group and cut number 0..n-1 from cells with ``_rank`` = how many cuts they pass.

    A cell passes cut i when its rank exceeds i. Per group at most n + 1 ranks remain, so the running sum is short.
    """
    by = [*by, *extra]
    cells = placed.groupBy(*by, "_rank").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # A row for every rank, so that a cut that no score falls on still appears.
    groups = cells.select(*by).distinct() if by else cells.agg(F.count(F.lit(1))).select()
    every = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_rank"),
                          F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    cells = cells.unionByName(every).groupBy(*by, "_rank").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = group.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = cells.select(*by, F.col("_rank").alias("cut"),
                          F.sum("neg").over(upto).alias("tn"), F.sum("pos").over(upto).alias("fn"),
                          F.sum("neg").over(group).alias("_neg"), F.sum("pos").over(group).alias("_pos"))
    return counts.where(F.col("cut") < n).select(
        *by, "cut", "tn", (F.col("_neg") - F.col("tn")).alias("fp"), "fn", (F.col("_pos") - F.col("fn")).alias("tp"))


def sweep_list(cells: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("model",),
               inclusive: bool = True) -> DataFrame:
    """Confusion counts at each of a few rising thresholds, in one pass over the cells."""
    thresholds = sorted(thresholds)
    placed = cells.withColumn("_rank", list_rank(F.col("pred"), thresholds, inclusive))
    at = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), (F.col("cut") + 1).cast("int"))
    return _sweep(placed, by, len(thresholds)).withColumn("threshold", at).drop("cut")


def sweep_grid(cells: DataFrame, n: int, lo: float = 0.0, hi: float | None = 1.0, by: Sequence[str] = ("model",),
               inclusive: bool = True) -> DataFrame:
    """Confusion counts at ``n`` evenly spaced thresholds from ``lo`` to ``hi`` (None: each group's highest score).

    A cell finds its place on the grid by arithmetic, so the work does not grow with the number of thresholds.
    """
    by = list(by)
    if hi is None:
        tops = cells.groupBy(*by).agg(F.max("pred").alias("_hi"))
        cells = cells.join(tops, by)
    else:
        cells = cells.withColumn("_hi", F.lit(float(hi)))
    low = F.lit(float(lo))
    placed = cells.withColumn("_rank", grid_rank(F.col("pred"), low, F.col("_hi"), n, inclusive))
    return _sweep(placed, by, n, ["_hi"]).withColumn("threshold", grid_point(F.col("cut"), low, F.col("_hi"), n)) \
        .drop("cut", "_hi")


def with_rates(counts: DataFrame) -> DataFrame:
    """The full metric set from tn, fp, fn, tp. Zero denominators give NULL, except F1, which is 0 then."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    n = tn + fp + fn + tp
    return counts.withColumns({
        "accuracy": F.try_divide(tp + tn, n), "base_rate": F.try_divide(tp + fn, n), "n": n,
        "f1": F.coalesce(F.try_divide(tp * 2, tp * 2 + fp + fn), F.lit(0.0)), "fpr": F.try_divide(fp, tn + fp),
        "fnr": F.try_divide(fn, fn + tp), "alert_rate": F.try_divide(fp + tp, n),
        "specificity": F.try_divide(tn, tn + fp), "sensitivity": F.try_divide(tp, fn + tp),
        "ppv": F.try_divide(tp, fp + tp), "npv": F.try_divide(tn, tn + fn)})


def with_calc_rates(counts: DataFrame) -> DataFrame:
    """The second metric set: shares among the predicted instead of among the true classes."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    n = tn + fp + fn + tp
    return counts.withColumns({
        "proportion_positive": F.try_divide(fp + tp, n), "accuracy": F.try_divide(tp + tn, n),
        "f1": F.coalesce(F.try_divide(tp * 2, tp * 2 + fp + fn), F.lit(0.0)),
        "false_discovery_rate": F.try_divide(fp, fp + tp), "false_omission_rate": F.try_divide(fn, fn + tn),
        "specificity": F.try_divide(tn, tn + fp), "sensitivity": F.try_divide(tp, fn + tp),
        "ppv": F.try_divide(tp, fp + tp), "npv": F.try_divide(tn, tn + fn)})


def tpr_specificity(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("model",)) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    return confusion(scores, threshold, by).select(
        *by, *COUNTS, F.try_divide(tp, tp + fn).alias("tpr"), F.try_divide(tn, tn + fp).alias("specificity"))


def binary_metrics(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("model",),
                   inclusive: bool = True) -> DataFrame:
    return with_rates(confusion(scores, threshold, by, inclusive))


def cv_metrics(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("model",)) -> DataFrame:
    """All metrics at one cut, with the AUC."""
    return binary_metrics(scores, threshold, by).join(auc_by(scores, by), list(by))


def calc_metrics(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("model",)) -> DataFrame:
    return with_calc_rates(confusion(scores, threshold, by, inclusive=False)).join(auc_by(scores, by), list(by))


def threshold_sweep_ge(scores: DataFrame, by: Sequence[str] = ("model",),
                       thresholds: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Fixed thresholds: AUC and average precision (once per group), TPR, specificity, confusion counts."""
    cells = score_cells(scores, by)
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    rates = sweep_list(cells, thresholds, by).withColumns({
        "tpr": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp)})
    return rates.join(rank_metrics_of_cells(cells, by), list(by))


def threshold_sweep_gt(scores: DataFrame, by: Sequence[str] = ("model",), n: int = 100) -> DataFrame:
    """``n`` thresholds from 0 to the group's highest score, scores above the threshold being positive."""
    return with_rates(sweep_grid(score_cells(scores, by), n, 0.0, None, by, inclusive=False))


def performance_sweep(scores: DataFrame, by: Sequence[str] = ("model",), n: int = 100) -> DataFrame:
    """``n`` thresholds from 0 to 1 with AUC, scores at or above the threshold being positive."""
    cells = score_cells(scores, by)
    return with_rates(sweep_grid(cells, n, 0.0, 1.0, by)).join(
        rank_metrics_of_cells(cells, by).drop("average_precision"), list(by))


def calc_metrics_sweep(scores: DataFrame, by: Sequence[str] = ("model",), n: int = 50, lo: float = 0.0,
                       hi: float = 1.0) -> DataFrame:
    cells = score_cells(scores, by)
    return with_calc_rates(sweep_grid(cells, n, lo, hi, by, inclusive=False)).join(
        rank_metrics_of_cells(cells, by).drop("average_precision"), list(by))


def nearest_row(table: DataFrame, column: str, target: float, by: Sequence[str] = ("model",),
                tie: str = "threshold") -> DataFrame:
    """Per group, the row whose ``column`` is nearest to ``target``; ties go to the lowest threshold."""
    gap = F.abs(F.col(column) - F.lit(float(target)))
    row = F.struct(*[F.col(c) for c in table.columns])
    best = F.min(F.when(gap.isNotNull(), F.struct(gap.alias("gap"), F.col(tie).alias("tie"), row.alias("row"))))
    return table.groupBy(*by).agg(best.alias("b")).select("b.row.*")


def operating_point(scores: DataFrame, alert_rate: float = 0.02, by: Sequence[str] = ("model",),
                    n: int = 100) -> DataFrame:
    """Per model, the threshold whose alert rate is nearest to the wanted one."""
    return nearest_row(threshold_sweep_gt(scores, by, n), "alert_rate", alert_rate, by)


def nearest_grid_threshold(target: float, n: int = 100) -> float:
    """The point of ``n`` evenly spaced ones from 0 to 1 that is nearest to ``target``, the lower one on ties."""
    points = [i * (1.0 / (n - 1)) if i < n - 1 else 1.0 for i in range(n)]
    return min(points, key=lambda p: (abs(p - target), p))


def subgroup_categorical(scores: DataFrame, category: str, target: float = 0.5,
                         by: Sequence[str] = ("model",)) -> DataFrame:
    """All metrics per category, at the grid threshold nearest to ``target``.

    The grid does not depend on the data, so only that one threshold is evaluated.
    """
    cut = nearest_grid_threshold(target)
    groups = [*by, category]
    return cv_metrics(scores, cut, groups).withColumn("threshold", F.lit(cut))


def subgroup_numeric(scores: DataFrame, column: str, target: float = 0.5, by: Sequence[str] = ("model",),
                     tiles: int = 10, min_rows: int = 5) -> DataFrame:
    """All metrics per numeric range (lo, hi] between ``tiles`` quantile points, so the minimum is in no range.

    Ranges with fewer than ``min_rows`` rows or without positives give only n and base rate 0.
    """
    by = list(by)
    probs = [i / (tiles - 1) for i in range(tiles)]
    # Groups are few here (models); each has one short array of edges, which goes to the rows, so that these stay put.
    edges = exact_quantiles(scores.select(*by, F.col(column).cast("double").alias(column)), column, probs, by) \
        .groupBy(*[F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(by)]) \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("prob", "quantile"))), lambda e: e["quantile"]).alias("_edges"))
    edges = F.broadcast(materialize(edges))
    same = reduce(Column.__and__, [F.col(quoted(c)).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    tile = count_below(F.col("_edges"), tiles, F.col(column))
    placed = scores.join(edges, same).withColumn("tile", tile).where((F.col("tile") > 0) & (F.col("tile") < tiles))
    cut = nearest_grid_threshold(target)
    groups = [*by, "tile"]
    # Scores may cost much to make, and the metrics read them several times.
    placed = materialize(placed.select(*[F.col(quoted(c)) for c in groups], "label", "pred"))
    table = cv_metrics(placed, cut, groups).withColumn("threshold", F.lit(cut))
    thin = (F.col("n") < min_rows) | (F.col("tp") + F.col("fn") == 0)
    keep = (*groups, "n")
    whole = lambda i: F.bround(F.get("_edges", i), 0).cast("bigint").cast("string")
    return table.join(edges, same, "left").select(
        *by, "tile", F.concat_ws("-", whole(F.col("tile") - 1), whole(F.col("tile"))).alias("range"), "n",
        *[(F.when(thin, F.lit(0.0)).otherwise(F.col(c)) if c == "base_rate" else F.when(~thin, F.col(c))).alias(c)
          for c in table.columns if c not in keep])


def model_report(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("model", "group")) -> DataFrame:
    """AUC, average precision, TPR and specificity per model and split."""
    return rank_metrics(scores, by).join(tpr_specificity(scores, threshold, by).drop(*COUNTS), list(by))


def scores_wide(scores: DataFrame, models: Sequence[str], key: str = "csn") -> DataFrame:
    """One row per key: the label and each model's score."""
    return scores.groupBy(key).agg(F.max("label").alias("label"), *[
        F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"pred_{m}") for m in models])


def scores_long(wide: DataFrame, models: Sequence[str], key: str = "csn") -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("pred")) for m in models]))
    return wide.select(key, "label", pairs.alias("s")).select(key, "label", "s.model", "s.pred")


def threshold_range(table: DataFrame, lo: float, hi: float, inclusive: bool = True) -> DataFrame:
    """Rows of a sweep with threshold from ``lo`` (or above it) to below ``hi``."""
    t = F.col("threshold")
    return table.where(((t >= lo) if inclusive else (t > lo)) & (t < hi))


def alert_share(scores: DataFrame, threshold: float, by: Sequence[str] = ("model",)) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg((F.col("pred") >= threshold).cast("double")).alias("share"))


def top_errors(scores: DataFrame, k: int = 20, by: Sequence[str] = ("model",), key: str = "csn") -> DataFrame:
    """The ``k`` highest-scored negatives and ``k`` lowest-scored positives per group.

    The rank filter is applied per input partition before the shuffle, so only k rows per group and task travel.
    """
    wrong = F.when(F.col("label") == 0, -F.col("pred")).otherwise(F.col("pred"))
    order = Window.partitionBy(*by, "label").orderBy("_wrong", key)
    return scores.withColumn("_wrong", wrong).withColumn("rank", F.row_number().over(order)) \
        .where(F.col("rank") <= k).drop("_wrong")


def score_histogram(scores: DataFrame, bins: int = 50, by: Sequence[str] = ("model", "label")) -> DataFrame:
    """Density per bin; every group is binned over its own range, its maximum falling in the last bin."""
    by = list(by)
    cells = scores.groupBy(*by, "pred").agg(F.count(F.lit(1)).alias("n"))
    spans = cells.groupBy(*by).agg(F.min("pred").alias("lo"), F.max("pred").alias("hi"), F.sum("n").alias("total"))
    place = F.least(grid_rank(F.col("pred"), F.col("lo"), F.col("hi"), bins + 1, True), F.lit(bins)) - 1
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    counts = cells.join(spans, by).withColumn("bin", place).groupBy(*by, "bin") \
        .agg(F.sum("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("total").alias("total"))
    return counts.select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"), "n",
                         F.try_divide(F.col("n"), F.col("total") * width).alias("density"))
