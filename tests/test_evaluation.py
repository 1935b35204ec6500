"""Metrics, quantiles, bootstrap, calibration and survival against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hindcast import queries
from hindcast.functions.beta import beta_quantile
from hindcast.functions.draws import POISSON_CUTS, MovedCounts, key_hash, mix32_array, poisson, poisson_array, poisson_cuts, poisson_table
from hindcast.functions.scalars import grid_rank
from hindcast.operators import metrics, resample, sampling, survival
from hindcast.operators.prefix import exact_quantiles, random_rank, running_sums
from hindcast.oracles import ORACLES


def score_table(spark, rows, model="m"):
    return spark.createDataFrame([(i, model, int(y), float(p)) for i, (y, p) in enumerate(rows)],
                                 "csn long, model string, label int, pred double")


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))


@pytest.fixture(scope="module")
def skewed():
    """A third of the scores are equal."""
    rng = np.random.default_rng(5)
    p = np.round(rng.random(900), 2)
    p[:300] = 0.25
    return (rng.random(900) < 0.2 + 0.5 * p).astype(int), p


@pytest.mark.parametrize("ranges", [2, 8, 64])
def test_auc_and_running_sums_do_not_depend_on_the_cut(spark, skewed, ranges):
    y, p = skewed
    df = score_table(spark, zip(y, p))
    assert metrics.rank_metrics(df, ranges=ranges).first().auc == pytest.approx(brute_auc(y, p), abs=1e-12)
    cells = df.groupBy("model", "pred").agg(F.count(F.lit(1)).alias("n"))
    got = running_sums(cells, "pred", {"upto": "n"}, ["model"], ranges=ranges).orderBy("pred").toPandas()
    assert list(got.upto) == list(pd.Series(p).value_counts().sort_index().cumsum())


@pytest.mark.parametrize("rows, auc, ap", [
    ([(1, .5), (0, .5), (1, .5), (0, .5)], 0.5, 0.5), ([(1, .9), (1, .8), (0, .2)], 1.0, 1.0),
    ([(0, .9), (0, .8), (1, .2)], 0.0, 1 / 3), ([(0, .1), (0, .2)], None, None), ([(1, .1), (1, .2)], None, 1.0)])
def test_auc_edges(spark, rows, auc, ap):
    got = metrics.rank_metrics(score_table(spark, rows)).first()
    assert got.auc == (None if auc is None else pytest.approx(auc))
    assert got.average_precision == (None if ap is None else pytest.approx(ap))


def test_auc_of_reversed_scores(spark, skewed):
    y, p = skewed
    both = score_table(spark, zip(y, p), "a").unionByName(score_table(spark, zip(y, 1 - p), "b"))
    aucs = {r.model: r.auc for r in metrics.auc_by(both).collect()}
    assert aucs["a"] + aucs["b"] == pytest.approx(1.0)


def test_one_class_metrics(spark):
    zeros = metrics.binary_metrics(score_table(spark, [(0, .1), (0, .9)])).first()
    assert (zeros.tn, zeros.fp, zeros.fn, zeros.tp, zeros.fnr, zeros.accuracy) == (1, 1, 0, 0, None, 0.5)
    ones = metrics.binary_metrics(score_table(spark, [(1, .1), (1, .9)])).first()
    assert (ones.fn, ones.tp, ones.fpr, ones.base_rate) == (1, 1, None, 1.0)
    none = metrics.binary_metrics(score_table(spark, [(0, .1), (1, .2)]), 0.5).first()
    assert (none.ppv, none.f1, none.npv) == (None, 0.0, 0.5)


def test_sweeps_equal_the_single_cut(spark, skewed):
    y, p = skewed
    df = score_table(spark, zip(y, p))
    for r in metrics.threshold_sweep_gt(df, n=20).collect():
        assert (r.tp, r.fp) == (int(((p > r.threshold) & (y == 1)).sum()), int(((p > r.threshold) & (y == 0)).sum()))
    for r in metrics.performance_sweep(df, n=101).collect():
        assert (r.tp, r.tn) == (int(((p >= r.threshold) & (y == 1)).sum()), int(((p < r.threshold) & (y == 0)).sum()))
    nine = metrics.threshold_sweep_ge(df).collect()
    assert sorted(r.threshold for r in nine) == [.1, .2, .3, .4, .5, .6, .7, .8, .9]


def test_grid_rank_equals_comparing_with_all_points(spark):
    rng = np.random.default_rng(1)
    lo, hi, n = 0.1, 0.73, 23
    step = (hi - lo) / (n - 1)
    points = np.array([lo + i * step for i in range(n - 1)] + [hi])
    values = np.r_[points, rng.random(200), -5.0, 9.0]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for inclusive in (True, False):
        got = df.select("v", grid_rank(F.col("v"), F.lit(lo), F.lit(hi), n, inclusive).alias("r")).collect()
        assert all(r.r == int(((points <= r.v) if inclusive else (points < r.v)).sum()) for r in got)
    flat = df.select("v", grid_rank(F.col("v"), F.lit(0.1), F.lit(0.1), n, True).alias("r")).collect()
    assert {(r.v >= 0.1, r.r) for r in flat} == {(True, n), (False, 0)}


def test_exact_quantiles(spark, skewed):
    _, p = skewed
    rows = [("a", float(v)) for v in p] + [("b", float(v)) for v in (3, 1, 2, 10)] + [("b", None), ("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.975, 1.0]
    got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, "v", probs, ["g"], ranges=16).collect()}
    for q in probs:
        assert got["a", q] == pytest.approx(np.quantile(p, q))
        assert got["b", q] == pytest.approx(np.quantile([3, 1, 2, 10], q))
        assert got["c", q] == 7.0


def test_subgroup_ranges_skip_the_minimum_and_thin_groups(spark):
    rng = np.random.default_rng(3)
    ages = np.r_[np.arange(1, 91), [1]]
    rows = [(i, "m", int(a > 60 and rng.random() < .5), float(rng.random()), float(a)) for i, a in enumerate(ages)]
    df = spark.createDataFrame(rows, "csn long, model string, label int, pred double, age double")
    got = metrics.subgroup_numeric(df, "age").orderBy("tile").collect()
    assert len(got) == 9 and sum(r.n for r in got) == len(ages) - (ages == 1).sum()
    assert got[0].base_rate == 0.0 and got[0].auc is None and got[0].accuracy is None
    assert got[-1].auc is not None


def test_top_errors_and_nearest_row(spark):
    df = score_table(spark, [(0, i / 100) for i in range(50)] + [(1, i / 100) for i in range(50)])
    worst = metrics.top_errors(df, 2).collect()
    assert sorted((r.label, r.pred) for r in worst) == [(0, .48), (0, .49), (1, .0), (1, .01)]
    t = spark.createDataFrame([("m", .2, 1.), ("m", .4, 2.), ("m", .9, None)], "model string, threshold double, x double")
    assert metrics.nearest_row(t, "threshold", 0.3).first().threshold == 0.2
    assert metrics.nearest_row(t, "x", 9.0).first().threshold == 0.4


def test_only_top_rows_are_shuffled_for_top_errors(spark):
    plan = metrics.top_errors(score_table(spark, [(0, .1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") >= 0 and "Partial" in plan


# Draws

def test_draw_functions_agree_between_spark_and_numpy(spark):
    df = key_hash(spark.range(1000), 7, "id", "h").withColumn("w", poisson(F.col("h")))
    got = df.orderBy("id").toPandas()
    low = mix32_array(np.arange(1000, dtype=np.uint64) ^ np.uint64(7))
    assert (got.h.to_numpy(np.uint64) == mix32_array(low)).all()
    assert (got.w.to_numpy() == poisson_array(got.h.to_numpy(np.uint32))).all()
    assert POISSON_CUTS[0] == math.floor(math.exp(-1) * 2**32)


def test_samples(spark):
    rows = spark.range(3000).select(F.col("id").alias("csn"), F.expr("if(id < 1000, 0, id % 100)").alias("empi"),
                                    (F.col("id") % 7 == 0).cast("int").alias("label"))
    one = sampling.sample_one(rows, 1)
    assert one.count() == one.select("empi").distinct().count() == 100
    split = sampling.split_patients_exact(rows, 5, 0.7)
    sides = split.groupBy("empi").agg(F.countDistinct("group").alias("k"), F.first("group").alias("g")).toPandas()
    assert (sides.k == 1).all() and (sides.g == "train").sum() == 70
    assert sampling.split_patients_exact(rows, 5, 0.0).where("group = 'train'").count() == 0
    folds = sampling.stratified_folds(rows, 5).groupBy("label", "fold").count().toPandas()
    assert folds.groupby("label")["count"].agg(lambda c: c.max() - c.min()).max() <= 1
    assert sampling.rows_of(rows, one.where("empi < 3")).count() == rows.where("empi < 3").count()
    ranks = random_rank(rows, 3, "csn", ranges=16).agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    assert tuple(ranks) == (1, 3000, 3000)


def test_bootstrap_draws(spark):
    keys = spark.range(500).select(F.col("id").alias("csn"))
    exact = sampling.bootstrap_draws(keys, 50).toPandas()
    assert (exact.groupby("b").weight.sum() == 500).all()
    assert exact.groupby("csn").weight.sum().between(15, 100).all()
    sizes = sampling.poisson_draws(keys, 50).groupBy("b").agg(F.sum("weight").alias("n")).toPandas()
    assert len(sizes) == 50 and abs(sizes.n.mean() - 500) < 15
    assert exact.equals(sampling.bootstrap_draws(keys, 50).toPandas()) or \
        sorted(map(tuple, exact.to_numpy())) == sorted(map(tuple, sampling.bootstrap_draws(keys, 50).toPandas().to_numpy()))


@pytest.mark.parametrize("ranges", [2, 16])
def test_bootstrap_aucs_against_brute_force(spark, skewed, ranges):
    y, p = skewed
    df = score_table(spark, zip(y, p))
    keys = df.select("csn")
    for draws, aucs in ((sampling.bootstrap_draws(keys, 12), resample.bootstrap_aucs(df, 12, ranges=ranges)),
                        (sampling.poisson_draws(keys, 12), resample.poisson_aucs(df, 12, ranges=ranges))):
        weights = draws.toPandas().pivot(index="csn", columns="b", values="weight").reindex(range(len(y))).fillna(0)
        got = {r.b: r.auc for r in aucs.collect()}
        for b in range(12):
            rows = np.repeat(np.arange(len(y)), weights[b].to_numpy(int))
            assert got[b] == pytest.approx(brute_auc(y[rows], p[rows]), abs=1e-12)


def test_added_draws_stay_off_the_driver(spark):
    """The added draws come from a table of a few rows, but are many: no join of theirs may be a broadcast."""
    keys = spark.range(3000).select(F.col("id").alias("csn"))
    plan = sampling.plan_resample(keys, 40)
    rows = sampling.with_added(keys, keys, plan, 12345, "csn")
    assert sum(len(r._extra or ()) for r in rows.collect()) == plan.missing.sum() > 0
    final = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in final.splitlines() if "Join [ordinal" in line or "Join [csn" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in j for j in joins)


def test_poisson_table():
    """The same counts as by comparing with every cut, at the cuts and beside them."""
    for cuts in (POISSON_CUTS, poisson_cuts(0.9), poisson_cuts(0.0)):
        edges = np.array([c + d for c in cuts for d in (-1, 0, 1) if 0 <= c + d < 2**32] + [0, 2**32 - 1], np.uint32)
        want = (edges[:, None] >= np.array(cuts, np.uint32)).sum(axis=1)
        assert (poisson_array(edges, cuts) == want).all() and (poisson_array(edges, cuts, poisson_table(cuts)) == want).all()


def test_counts_in_place_are_the_plain_ones():
    """For all pairs, in calls of changing size, and for hashes that reach more cuts than are compared."""
    slots, moved = (np.random.default_rng(s).integers(0, 2**32, n, dtype=np.uint32) for s, n in ((1, 700), (2, 301)))
    for cuts in (POISSON_CUTS, poisson_cuts(0.9), poisson_cuts(0.0)):
        counts = MovedCounts(cuts)
        want = poisson_array(mix32_array(slots[:, None] + moved[None, :]), cuts)
        for n in (3, 700, 1, 512):
            assert (counts(slots[:n], moved) == want[:n]).all()
        assert (counts(slots[:41], moved[:7]) == want[:41, :7]).all()
        assert (sampling.column_sums(want) == want.sum(axis=0, dtype=int)).all()
    assert poisson_array(mix32_array(slots[:, None] + moved[None, :])).max() > 5


def test_pieces_hold_every_row_once():
    for sizes in ([1, 1, 1], [40, 1, 17, 300], [5000], [2, 3] * 50):
        size, place, first = resample._pieces(np.array(sizes))
        run = np.repeat(np.arange(len(sizes)), sizes)
        assert len(set(place)) == sum(sizes) and (np.searchsorted(first, place // size, "right") - 1 == run).all()


def test_range_wins_over_blocks(skewed):
    """Stretches that go over several blocks of rows and scores shared by both classes, against brute force."""
    y, p = (np.tile(a, 3) for a in skewed)
    pdf = pd.DataFrame({"model": "m", "_range": 0, "label": y, "pred": p, "_slot": np.arange(len(y)) * 7919})
    pdf["_extra"] = [[i % 300, i % 300] if i % 7 == 0 else None for i in range(len(y))]
    out = resample._range_wins(300, resample._weights(np.arange(300), POISSON_CUTS))(pdf)
    w = sampling.row_counts(pdf["_slot"].to_numpy(), np.arange(300), POISSON_CUTS).astype(int)
    w[np.arange(0, len(y), 7), np.arange(0, len(y), 7) % 300] += 2
    better = (p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])
    for b in (0, 1, 7, 299):
        pos, neg = w[y == 1, b], w[y == 0, b]
        assert tuple(out.iloc[b][["b", "pos", "neg", "wins"]]) == (b, pos.sum(), neg.sum(), pos @ better @ neg)


def test_one_class_replicates(spark):
    df = score_table(spark, [(1, .5), (0, .4), (0, .3)])
    aucs = resample.bootstrap_aucs(df, 60)
    missing = aucs.where("auc is null").count()
    assert 0 < missing < 60
    assert resample.auc_interval(aucs).first().replicates == 60 - missing


def test_model_comparison(spark, skewed):
    y, p = skewed
    rng = np.random.default_rng(2)
    both = score_table(spark, zip(y, p), "good").unionByName(score_table(spark, zip(y, rng.random(len(y))), "noise"))
    for method in ("exact", "poisson"):
        row = resample.bootstrap_compare(both, ["good", "noise"], 100, method=method).first()
        assert row.p_greater > 0.95 and row.lower_a < row.mean_a < row.upper_a and row.alpha_each == 0.05


# Intervals, calibration, survival

def test_beta_quantiles():
    # Beta(1, n): quantile 1 - (1 - p)^(1/n); Beta(a, 1): p^(1/a); symmetric: 1/2.
    assert beta_quantile(.025, [1.0], [11.0])[0] == pytest.approx(1 - .975 ** (1 / 11), abs=1e-10)
    assert beta_quantile(.975, [8.0], [1.0])[0] == pytest.approx(.975 ** (1 / 8), abs=1e-10)
    assert beta_quantile(.5, [40.0], [40.0])[0] == pytest.approx(.5, abs=1e-10)
    # Beta(k, n) counts the k least of n + k - 1 draws: a binomial tail, added up.
    for k, n, p in ((3, 9, .025), (40, 7, .975), (12, 300, .5)):
        x, m = beta_quantile(p, [k], [n])[0], n + k - 1
        assert sum(math.comb(m, i) * x**i * (1 - x) ** (m - i) for i in range(k, m + 1)) == pytest.approx(p, abs=1e-10)


@pytest.mark.parametrize("count", [1.0, 10.0, 1e3, 99_000.0, 101_000.0, 1e7, 1e10])
def test_beta_quantiles_of_large_counts(count):
    """One method for all counts: closed forms beside a count of one, mirrored shares, the normal limit."""
    for p in (1e-6, .025, .5, .975):
        low, high = beta_quantile(p, [1.0], [count])[0], beta_quantile(1 - p, [count], [1.0])[0]
        assert low == pytest.approx(-math.expm1(math.log1p(-p) / count), rel=1e-8)
        assert 1 - high == pytest.approx(low, rel=1e-8, abs=1e-15)
        both = beta_quantile(p, [count, 3 * count], [3 * count, count])
        if p == .025:
            assert both[0] == pytest.approx(1 - beta_quantile(.975, [3 * count], [count])[0], rel=1e-9)
        if count >= 1e7:
            z = {1e-6: -4.753424308822899, .025: -1.959963984540054, .5: 0, .975: 1.959963984540054}[p]
            sd = math.sqrt(.25 * .75 / (4 * count + 1))
            assert both[0] == pytest.approx(.25 + sd * (z + (z * z - 1) * .5 / (6 * math.sqrt(.25 * .75 * 4 * count)) * 2),
                                            abs=sd * 1e-3)
    assert (np.diff([beta_quantile(p, [count], [5.0])[0] for p in (.1, .3, .5, .7, .9)]) > 0).all()
    assert len(beta_quantile(.5, [], [])) == 0


def test_calibration(spark):
    rows = [(1, .0), (0, .05), (1, .1), (0, .95), (1, 1.0)]
    got = survival.calibration(score_table(spark, rows)).orderBy("bin").collect()
    assert [r.n for r in got] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 1] and got[0].positives == 1
    assert sum(r.n for r in survival.calibration(score_table(spark, rows), include_max=True).collect()) == 5
    flat = survival.calibration(score_table(spark, [(1, .4), (0, .4)])).collect()
    assert len(flat) == 10 and sum(r.n for r in flat) == 0
    table = survival.with_interval(survival.calibration(score_table(spark, rows)), "positives", "n").collect()
    assert all(0 <= r.lower < r.upper <= 1 for r in table)


def test_survival(spark):
    surv = [float("inf"), 1.0, 0.5, 2.5, 400.0, 3.0]
    rows = [(i, "m", .9 if i % 2 else .1, s) for i, s in enumerate(surv)]
    df = spark.createDataFrame(rows, "csn long, model string, pred double, surv double")
    curves = survival.empirical_survival(df, [.5, .05], 5).collect()
    for r in curves:
        group = [s for _, _, p, s in rows if (p > r.cut) == (r.risk == "High risk")]
        assert (r.n_group, r.n_survived) == (len(group), sum(s > r.day for s in group))
        assert r.group_share == pytest.approx(len(group) / 6)
    ordered = sorted((r.cut, r.risk, r.day, r.n_survived) for r in curves)
    assert all(a[3] >= b[3] for a, b in itertools.pairwise(ordered) if a[:2] == b[:2])


def test_histogram(spark, skewed):
    y, p = skewed
    got = metrics.score_histogram(score_table(spark, zip(y, p)), 10).toPandas()
    for label in (0, 1):
        counts, _ = np.histogram(p[y == label], 10)
        mine = got[got.label == label].set_index("bin").n.reindex(range(10)).fillna(0)
        assert list(mine) == list(counts)


# Rows by rank

def test_scores_are_made_once(spark):
    """Metrics that read scores several times do not make them several times."""
    df = spark.range(400).select(
        F.col("id").alias("csn"), F.when(F.col("id") % 5 > 0, F.lit("m")).alias("model"), (F.col("id") % 3 == 0).cast("int").alias("label"),
        (F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32).alias("pred"),
        (F.col("id") % 37).cast("double").alias("age"))
    found = metrics.subgroup_numeric(df, "age", 0.3)
    assert "md5(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got, want = {r.tile: r for r in found.collect()}, df.where("model = 'm'").toPandas()
    edges = np.quantile(want.age, np.linspace(0, 1, 10))
    for tile in range(1, 10):
        part = want[(want.age > edges[tile - 1]) & (want.age <= edges[tile])]
        assert got[tile].n == len(part) and got[tile].tp == ((part.pred >= got[tile].threshold) & (part.label == 1)).sum()
        assert got[tile].auc == pytest.approx(brute_auc(part.label.to_numpy(), part.pred.to_numpy()), abs=1e-12)


def test_rows_by_rank(spark):
    """The same rows as by numbering all of them, without a sort or shuffle of the table."""
    df = spark.range(3000).select((F.col("id") * 7).alias("csn"), (F.col("id") % 5).alias("slot"))
    draws = spark.range(40).selectExpr("id AS draw", "id * 70 AS ordinal")
    picked = sampling.rows_by_rank(df, draws, 3, "csn")
    want = sampling.row_ordinals(df, 3, "csn").where("ordinal % 70 = 0 AND ordinal < 2800").join(df, "csn")
    assert sorted((r.draw * 70, r.csn, r.slot) for r in picked.collect()) == sorted((r.ordinal, r.csn, r.slot) for r in want.collect())
    assert sampling.rows_by_rank(df.where("false"), draws, 3, "csn").collect() == []
    sample = sampling.background_sample(df, spark.range(500).withColumnRenamed("id", "draw"), 1, "csn")
    assert sample.count() == 500 and sample.columns == ["draw", "csn", "slot"]
    assert sampling.background_sample(df.limit(1), spark.range(9).withColumnRenamed("id", "draw"), 1, "csn").count() == 9


def test_comparison_draws_all_replicates(monkeypatch):
    """The reference's 10,000, in the query and in its SQL twin."""
    asked = []
    monkeypatch.setattr(queries, "_scores", lambda spark, sf: None)
    monkeypatch.setattr(queries, "rounded", lambda df: df)
    monkeypatch.setattr(resample, "bootstrap_compare", lambda scores, models, replicates: asked.append(replicates))
    queries.QUERIES["bootstrap_compare"](None, None)
    assert asked == [10_000] and "range(10000)" in ORACLES["bootstrap_compare"]
