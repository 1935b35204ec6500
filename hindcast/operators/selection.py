"""Feature selection and normalisation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import quoted
from hindcast.operators.prefix import count_below, exact_quantiles

CORR_TASKS = 2000
NO_SPREAD = 1e-12  # share of the sum of squares that rounding may leave


def _long(pairs: list, names: tuple[str, ...]) -> F.Column:
    return F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(p, names, strict=True)]) for p in pairs]))


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep..., feature, value), values as doubles."""
    pairs = [(F.lit(f), F.col(quoted(f)).cast("double")) for f in features]
    return df.select(*keep, _long(pairs, ("feature", "value")).alias("r")).select(*keep, "r.*")


def variances(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, variance), sample variance, all features in one pass."""
    row = df.agg(*[F.var_samp(quoted(f)).alias(f"v{i}") for i, f in enumerate(features)])
    return row.select(_long([(F.lit(f), F.col(f"v{i}")) for i, f in enumerate(features)], ("feature", "variance"))
                      .alias("r")).select("r.*")


def drop_zero_variance(df: DataFrame, features: Sequence[str]) -> list[str]:
    """The features that vary. What reaches the driver is one number per feature."""
    zero = {r.feature for r in variances(df, features).where("variance = 0").collect()}
    return [f for f in features if f not in zero]


def corr_pairs(df: DataFrame, features: Sequence[str], tasks: int = CORR_TASKS) -> DataFrame:
    """(f1, f2, corr) for f1 before f2 in the given order: Pearson over rows where both are present.

    Each task turns its rows into cross-product matrices, and only those are added up; at most ``tasks`` tasks read the
    rows, so what is shuffled is bounded by that number and the number of pairs, not by the rows. A pair has NULL where
    one of the two does not vary, beyond rounding, over the rows they share.
    """
    k = len(features)
    # Values are shifted by the feature's mean, so that the products lose no digits.
    means = df.agg(*[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)]) \
        .select(F.struct(*[f"m{i}" for i in range(k)]).alias("m")).scalar()
    shifted = df.withColumn("_m", means).select(*[
        (F.col(quoted(f)).cast("double") - F.col(f"_m.m{i}")).alias(f"x{i}") for i, f in enumerate(features)])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, k, k))
        for pdf in batches:
            x = pdf.to_numpy(float)
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, x.T @ x, (x * x).T @ m, m.T @ (x * x)])
        i, j = np.triu_indices(k, 1)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32),
                            **{n: total[t][i, j] for t, n in enumerate(("n", "sx", "sy", "sxy", "sxx", "syy"))}})

    sums = shifted.coalesce(tasks).mapInPandas(products, "i int, j int, n double, sx double, sy double, sxy double, sxx double, "
                                         "syy double").groupBy("i", "j") \
        .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))

    def spread(q: str, s: str) -> F.Column:
        left = F.col(q) - F.try_divide(F.col(s) * F.col(s), F.col("n"))
        return F.when(left > F.col(q) * NO_SPREAD, left)

    names = F.array(*[F.lit(f) for f in features])
    at = lambda c: F.element_at(names, F.col(c) + 1)
    return sums.select(at("i").alias("f1"), at("j").alias("f2"),
                       F.try_divide(cov, F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy"))).alias("corr"))


def correlation_groups(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> dict[str, list[str]]:
    """Kept feature to the features it stands for, walking the features in order.

    A feature that is not grouped yet is kept, and takes every other feature with signed correlation above the
    threshold; this is not transitive. Spark finds the pairs above the threshold; the walk reads those names only.
    """
    near_pair = (F.col("corr") > threshold) & ~F.isnan("corr")
    pairs = corr_pairs(df, features).where(near_pair).select("f1", "f2").collect()
    near: dict[str, set[str]] = {f: set() for f in features}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    grouped: set[str] = set()
    groups = {}
    for f in features:
        if f not in grouped:
            groups[f] = [g for g in features if g in near[f]]
            grouped.update(groups[f])
    return groups


def kept_after_grouping(features: Sequence[str], groups: dict[str, list[str]]) -> list[str]:
    """Features that no representative has taken (a representative may itself be taken by a later one)."""
    taken = {m for members in groups.values() for m in members}
    return [f for f in features if f not in taken]


def mutual_information(df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 10) -> DataFrame:
    """(feature, score): mutual information in nats between each feature's quantile bin and the label.

    A plug-in estimate over bins (lo, hi] between distinct quantile points; it is rarely exactly 0, so the drop rule
    is "at most ``min_mi``". Counts per (feature, bin, label) combine on the map side.
    """
    rows = unpivot(df, features, [label]).where(F.col("value").isNotNull())
    edges = exact_quantiles(rows, "value", [i / bins for i in range(1, bins)], ["feature"]) \
        .groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias("_edges"))
    # One short array per column of the table: small by construction.
    placed = rows.join(F.broadcast(edges), "feature") \
        .withColumn("bin", count_below(F.col("_edges"), bins - 1, F.col("value")))
    counts = placed.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("n"))
    part = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    joint = counts.select("feature", "n", part("feature", "bin").alias("nb"), part("feature", label).alias("nl"),
                          part("feature").alias("total"))
    n, nb, nl, total = (F.col(c).cast("double") for c in ("n", "nb", "nl", "total"))
    return joint.groupBy("feature").agg(F.sum(n / total * F.log(n * total / (nb * nl))).alias("score"))


def select_features(df: DataFrame, features: Sequence[str], label: str = "label", corr_threshold: float = 0.95,
                    min_mi: float = 0.0, bins: int = 10) -> list[str]:
    """Drop constant features, then correlated ones, then those without information on the label."""
    varying = drop_zero_variance(df, features)
    kept = kept_after_grouping(varying, correlation_groups(df, varying, corr_threshold))
    low = {r.feature for r in mutual_information(df, kept, label, bins).where(F.col("score") <= min_mi).collect()}
    return [f for f in kept if f not in low]


def normalise(train: DataFrame, frames: Sequence[DataFrame], features: Sequence[str],
              no_log: Sequence[str] = ()) -> list[DataFrame]:
    """z-scores by the mean and sample deviation of ``train``; features outside ``no_log`` get log(x + 1) first.

    The statistics are one row, read as a subquery value. A feature without spread becomes NULL.
    """
    value = lambda f: F.col(quoted(f)).cast("double") if f in no_log else F.log1p(F.col(quoted(f)))
    stats = train.agg(*[agg(value(f)).alias(f"{s}{i}") for i, f in enumerate(features)
                        for s, agg in (("m", F.avg), ("s", F.stddev_samp))])
    row = stats.select(F.struct(*stats.columns).alias("r")).scalar()
    place = {f: i for i, f in enumerate(features)}
    scaled = lambda f: F.try_divide(value(f) - F.col(f"_r.m{place[f]}"), F.col(f"_r.s{place[f]}"))
    return [df.withColumn("_r", row).select(*[scaled(c).alias(c) if c in place else F.col(quoted(c)) for c in df.columns])
            for df in frames]


def normalisation_stats(train: DataFrame, features: Sequence[str], no_log: Sequence[str] = ()) -> DataFrame:
    """(feature, mean, std) used by ``normalise``."""
    value = lambda f: F.col(quoted(f)).cast("double") if f in no_log else F.log1p(F.col(quoted(f)))
    row = train.agg(*[agg(value(f)).alias(f"{s}{i}") for i, f in enumerate(features)
                      for s, agg in (("m", F.avg), ("s", F.stddev_samp))])
    return row.select(_long([(F.lit(f), F.col(f"m{i}"), F.col(f"s{i}")) for i, f in enumerate(features)],
                            ("feature", "mean", "std")).alias("r")).select("r.*")
