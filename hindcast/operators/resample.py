"""Bootstrap intervals and comparisons of AUCs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.draws import POISSON_CUTS, MovedCounts, key_hash
from hindcast.operators.prefix import cut_points, with_range
from hindcast.operators.sampling import CELLS, moves, plan_resample, with_added
from hindcast.session import shuffle_width


WIDTH, SEGMENT_CELLS = 256, 1 << 20  # replicates side by side; stretches times replicates
PIECES = (1, 2, 4, 8, 16)  # rows added up as bytes: 16 counts of at most 13 each


@dataclass(frozen=True)
class Weights:
    """What rows draw by themselves: Poisson counts by the cuts, in a stream for each replicate."""

    streams: np.ndarray
    cuts: Sequence[int]

    def added(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(replicate, row) of the draws that rows bring, by replicate."""
        lists = [x if x is not None else () for x in pdf["_extra"]] if "_extra" in pdf else []
        b = np.concatenate([*map(np.asarray, lists), []]).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(b, kind="stable")
        return b[order], row[order]


def _weights(streams: np.ndarray, cuts: Sequence[int]) -> Weights:
    return Weights(streams, cuts)


def _pieces(sizes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Runs of rows in pieces of one size, the last of each run filled up: (rows a piece, place of each row, first piece of
    each run). The size is that with the least work; a piece costs about half as much as a row."""
    size = min(PIECES, key=lambda p: (-(-sizes // p)).sum() * (2 * p + 1))
    pieces = -(-sizes // size)
    first = np.cumsum(pieces) - pieces
    return size, np.arange(sizes.sum()) + np.repeat(first * size - (np.cumsum(sizes) - sizes), sizes), first


def _segments(pred: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, kind) of stretches of sorted rows: 1 positives only, 2 negatives only, 3 both, of one score. Pairs inside a
    stretch are of one class or tied, so only its totals matter."""
    ties = np.flatnonzero(np.r_[True, pred[1:] != pred[:-1]])
    kind = np.maximum.reduceat(positive, ties).astype(int) + 2 * np.maximum.reduceat(~positive, ties)
    new = (kind == 3) | np.r_[True, kind[1:] != kind[:-1]]
    return ties[new], kind[new]


def _range_wins(replicates: int, weights: Weights) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Per group of rows: for each replicate the weights of positives and negatives, and the pairs won inside.

    A stretch is a run of rows of one class, or two of them if its score has both. Runs are laid out in pieces of a few rows;
    a piece's counts are added up as bytes, many replicates at once, and the pieces of a run are added up then.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pred", ascending=False, kind="stable")
        positive, n = pdf["label"].to_numpy() == 1, len(pdf)
        starts, _ = _segments(pdf["pred"].to_numpy(), positive)
        stretch = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        # Within a stretch the positives come last, whatever other labels there are.
        order = np.lexsort((positive, stretch))
        pdf, positive = pdf.iloc[order], positive[order]
        runs = np.flatnonzero(np.r_[True, (stretch[1:] != stretch[:-1]) | (positive[1:] != positive[:-1])])
        size, place, first_piece = _pieces(np.diff(np.r_[runs, n]))
        pieces = place[-1] // size + 1
        slots, filled = np.zeros(pieces * size, np.uint32), np.zeros(pieces * size, bool)
        slots[place], filled[place] = pdf["_slot"].to_numpy(), True
        empty, of_run, won_by = np.flatnonzero(~filled), stretch[runs], positive[runs]
        width = min(WIDTH, max(1, SEGMENT_CELLS // len(starts)))
        counts, moved = MovedCounts(weights.cuts), moves(weights.streams)
        (added, row), parts = weights.added(pdf), []
        for first in range(0, replicates, width):
            last = min(first + width, replicates)
            total = np.zeros((len(runs), last - first), np.int64)
            step = max(1, CELLS // (last - first) // size)
            for lo in range(0, pieces, step):
                hi = min(lo + step, pieces)
                w = counts(slots[lo * size:hi * size], moved[first:last])
                w[empty[slice(*np.searchsorted(empty, [lo * size, hi * size]))] - lo * size] = 0
                w = np.add.reduce(w.reshape(hi - lo, size, last - first), axis=1, dtype=np.uint8)
                a, b = np.searchsorted(first_piece, lo, "right") - 1, np.searchsorted(first_piece, hi)
                total[a:b] += np.add.reduceat(w, np.maximum(first_piece[a:b] - lo, 0), axis=0, dtype=np.int64)
            own = slice(*np.searchsorted(added, [first, last]))
            np.add.at(total, (np.searchsorted(runs, row[own], "right") - 1, added[own] - first), 1)
            pos, neg = (np.zeros((len(starts), last - first)) for _ in range(2))
            pos[of_run[won_by]], neg[of_run[~won_by]] = total[won_by], total[~won_by]
            above = np.cumsum(pos, axis=0)
            total = above[-1].copy()
            above -= pos / 2
            parts.append((total, neg.sum(axis=0), np.einsum("ij,ij->j", neg, above)))
        out = pd.DataFrame({"b": np.arange(replicates, dtype=np.int32)}
                           | {c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("pos", "neg", "wins"))})
        out["model"], out["_range"] = pdf["model"].iloc[0], pdf["_range"].iloc[0]
        return out[["model", "_range", "b", "pos", "neg", "wins"]]

    return run


def _aucs(rows: DataFrame, scores: DataFrame, replicates: int, weights: Weights, ranges: int) -> DataFrame:
    """AUC per (replicate, model) from rows (model, label, pred, _slot and what ``weights`` reads).

    Scores are cut into ranges; a range gives its totals and the pairs won inside it, and ranges are then added up. A
    score that is itself a cut point (so any score held by a large share of the rows) is a range of its own; in it all
    pairs are ties, only the totals matter, and so it is dealt over as many tasks as its share of the rows calls for.
    """
    rows = rows.withColumn("_cuts", cut_points(scores, "pred", ranges))
    # How often a score is a cut point tells its share of the rows, in units of one range.
    share = F.size("_cuts.p") - F.size(F.array_remove("_cuts.p", F.col("pred")))
    place = F.col("_range") * 2 + F.when(F.col("_share") > 0, F.lit(1)).otherwise(F.lit(0))
    rows = with_range(rows, F.col("_cuts"), "pred", ranges).withColumn("_share", share) \
        .withColumn("_salt", F.pmod("_slot", F.greatest("_share", F.lit(1)))).withColumn("_range", place) \
        .drop("_cuts", "_share")
    parts = rows.groupBy("model", "_range", "_salt").applyInPandas(
        _range_wins(replicates, weights), "model string, _range int, b int, pos double, neg double, wins double")
    # The order of a range is fixed by its number: 2k+1 is cut point k+1, just above the open range 2k.
    per_range = parts.groupBy("model", "b", "_range").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("wins").alias("wins")) \
        .withColumn("wins", F.when(F.col("_range") % 2 == 1, F.col("pos") * F.col("neg") / 2)
                    .otherwise(F.col("wins")))
    above = Window.partitionBy("model", "b").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("wins") + F.col("neg") * F.coalesce("_above", F.lit(0.0))
    return per_range.withColumn("_above", F.sum("pos").over(above)).groupBy("b", "model") \
        .agg(F.try_divide(F.sum(won), F.sum("pos") * F.sum("neg")).alias("auc"))


def bootstrap_aucs(scores: DataFrame, replicates: int, seed: int = 12345, key: str = "csn",
                   ranges: int | None = None) -> DataFrame:
    """AUC per (replicate, model) from n-of-n draws; all models see the same draws. One-class draws give NULL.

    ``scores`` has one row per model and key. A row draws most of its weights where it lands, from its key, and brings the
    few draws that were added (see ``Resample``), so shuffles and memory do not grow with rows times replicates.
    """
    ranges = ranges or shuffle_width(scores.sparkSession)
    keys = scores.select(key).distinct()
    plan = plan_resample(keys, replicates, seed, key)
    rows = key_hash(scores.select("model", key, "label", F.col("pred").cast("double")), seed, key, "_slot")
    rows = with_added(rows, keys, plan, seed, key).select("model", "label", "pred", "_slot", "_extra")
    return _aucs(rows, scores, replicates, _weights(plan.streams, plan.cuts), ranges)


def poisson_aucs(scores: DataFrame, replicates: int, seed: int = 12345, key: str = "csn",
                 ranges: int | None = None) -> DataFrame:
    """AUC per (replicate, model) with Poisson(1) weights.

    Each score row is shuffled once, whatever the number of replicates: its weights are drawn from its key where it
    lands.
    """
    ranges = ranges or shuffle_width(scores.sparkSession)
    rows = key_hash(scores.select("model", key, "label", F.col("pred").cast("double")), seed, key, "_slot") \
        .select("model", "label", "pred", "_slot")
    return _aucs(rows, scores, replicates, _weights(np.arange(replicates), POISSON_CUTS), ranges)


def auc_interval(aucs: DataFrame, ci: float = 95) -> DataFrame:
    """Mean and percentile interval per model over its replicates; draws with one class only are skipped."""
    low = (100 - ci) / 200
    q = lambda p: F.percentile("auc", F.lit(p))
    return aucs.where("auc is not null").groupBy("model").agg(
        F.avg("auc").alias("mean_auc"), q(low).alias("lower"), q(1 - low).alias("upper"),
        F.count(F.lit(1)).alias("replicates"))


def auc_ci(scores: DataFrame, replicates: int = 1000, ci: float = 95, seed: int = 12345, key: str = "csn",
           method: str = "exact") -> DataFrame:
    draw = {"exact": bootstrap_aucs, "poisson": poisson_aucs}[method]
    return auc_interval(draw(scores, replicates, seed, key), ci)


def compare_models(aucs: DataFrame, models: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Per pair of models: share of replicates in which the first has the higher AUC, both means and intervals, and
    the level per comparison after Bonferroni. A replicate without an AUC counts as not higher."""
    pairs = list(combinations(models, 2))
    wide = aucs.groupBy("b").agg(*[F.max(F.when(F.col("model") == m, F.col("auc"))).alias(f"auc_{m}")
                                   for m in models])
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"auc_{a}").alias("a"),
                 F.col(f"auc_{b}").alias("b")) for a, b in pairs])).alias("r")
    q = lambda c, p: F.percentile(c, F.lit(p))
    return wide.select(rows).select("r.*").groupBy("model_a", "model_b").agg(
        F.avg(F.coalesce(F.col("a") > F.col("b"), F.lit(False)).cast("double")).alias("p_greater"),
        F.avg("a").alias("mean_a"), q("a", 0.025).alias("lower_a"), q("a", 0.975).alias("upper_a"),
        F.avg("b").alias("mean_b"), q("b", 0.025).alias("lower_b"), q("b", 0.975).alias("upper_b"),
        F.lit(alpha / len(pairs)).alias("alpha_each"))


def bootstrap_compare(scores: DataFrame, models: Sequence[str], replicates: int = 10_000, seed: int = 12345,
                      key: str = "csn", method: str = "exact") -> DataFrame:
    draw = {"exact": bootstrap_aucs, "poisson": poisson_aucs}[method]
    return compare_models(draw(scores, replicates, seed, key), models)
