"""Selection, fitting and the training job on small separable data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from hindcast import queries
from hindcast.operators import explain, metrics, models, selection
from hindcast.plans import modelling, train
from hindcast.session import shared_dir
from hindcast.sources.tables import load_features, load_model, save_features


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    pdf = pd.DataFrame({"csn": range(400), "empi": np.arange(400) // 2, "pat_id": "p", "label": y, "A: last": x[:, 0],
                        "n_b": np.abs(x[:, 1]), "s>>>c": (x[:, 2] > 0).astype(int), "pat_age": rng.integers(20, 90, 400),
                        "sex_c": rng.integers(1, 3, 400)})
    return spark.createDataFrame(pdf).cache()


NAMES = ["A: last", "n_b", "s>>>c", "pat_age", "sex_c"]


def test_correlations_with_missing_values(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    x[:, 1] += 3 * x[:, 0]
    pdf = pd.DataFrame(x, columns=list("abcd")).mask(rng.random((300, 4)) < 0.1)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double")
    want = pdf.corr()
    for pairs in (selection.corr_pairs(df, list("abcd")), selection.corr_pairs(df, list("abcd"), tasks=1)):
        rows = pairs.collect()
        assert len(rows) == 6
        assert all(r["corr"] == pytest.approx(want.loc[r.f1, r.f2], abs=1e-9) for r in rows)


def test_columns_without_spread_have_no_correlation(spark):
    """Also one that is constant only where the other is present, and among more columns than fit one expression list."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(200, 26)), columns=[f"c{i}" for i in range(26)])
    pdf["flat"] = 0.1
    pdf["part"] = np.where(np.arange(200) % 2 == 0, 0.3, pdf.c0)
    pdf["even"] = pdf.c1.where(np.arange(200) % 2 == 0)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf))
    got = {(r.f1, r.f2): r["corr"] for r in selection.corr_pairs(df, list(pdf)).collect()}
    assert len(got) == 29 * 28 // 2
    assert {p for p, c in got.items() if c is None} == {p for p in got if "flat" in p} | {("part", "even")}
    want = pdf.corr()
    assert all(c == pytest.approx(want.loc[p], abs=1e-9) for p, c in got.items() if c is not None)
    assert selection.correlation_groups(df, list(pdf))["c2"] == []


def test_groups_are_signed_and_not_transitive(spark):
    rng = np.random.default_rng(1)
    a, e = rng.normal(size=5000), rng.normal(size=(2, 5000))
    b = a + 0.25 * e[0]
    pdf = pd.DataFrame({"a": a, "b": b, "c": b + 0.25 * e[1], "minus": -a, "flat": 1.0})
    df = spark.createDataFrame(pdf)
    names = selection.drop_zero_variance(df, list(pdf))
    assert names == ["a", "b", "c", "minus"]
    groups = selection.correlation_groups(df, names)
    assert groups == {"a": ["b"], "c": ["b"], "minus": []}
    assert selection.kept_after_grouping(names, groups) == ["a", "c", "minus"]


def test_mutual_information_ranks_the_signal_first(table):
    scores = {r.feature: r.score for r in selection.mutual_information(table, NAMES).collect()}
    assert max(scores, key=scores.get) == "A: last" and scores["A: last"] > 0.3
    assert "A: last" in selection.select_features(table, NAMES, min_mi=0.05)


def test_normalise_uses_train_statistics(spark, table):
    train_rows, test_rows = table.where("csn < 200"), table.where("csn >= 200")
    out = selection.normalise(train_rows, [train_rows, test_rows], ["A: last", "n_b"], ["A: last"])
    stats = out[0].agg(F.avg("A: last"), F.stddev_samp("A: last"), F.avg("n_b"), F.stddev_samp("n_b")).first()
    assert list(stats) == pytest.approx([0, 1, 0, 1], abs=1e-9)
    want = train_rows.select(F.log1p("n_b").alias("v")).toPandas().v
    raw = test_rows.orderBy("csn").first().n_b
    assert out[1].orderBy("csn").first().n_b == pytest.approx((np.log(raw + 1) - want.mean()) / want.std())
    assert selection.normalisation_stats(train_rows, ["n_b"]).first()["mean"] == pytest.approx(want.mean())


def test_search_space_and_depth_limit():
    points = models.sample_space(models.RF_SEARCH, 20)
    assert len({str(p) for p in points}) == 20 and models.sample_space(models.RF_SEARCH, 20) == points
    maps = models._param_maps(models.random_forest(), [{"maxDepth": None}, {"maxDepth": 100}, {"maxDepth": 5}])
    assert [list(m.values())[0] for m in maps] == [30, 30, 5]
    assert len(models.full_grid(models.RF_GRID)) == 3 * 4 * 3 * 3 * 2
    assert len(models.sample_space({"a": [1, 2]}, 9)) == 2


@pytest.mark.parametrize("kind, space", [("rf", {"numTrees": [5], "maxDepth": [2, 3]}),
                                         ("gb", {"maxIter": [3], "maxDepth": [2]})])
def test_searches_find_the_signal(spark, table, kind, space):
    model, results = models.random_search(table, NAMES, kind, 2, 2, space)
    assert results.count() == len(models.full_grid(space)) and results.agg(F.max("score")).first()[0] > 0.85
    scored = models.score(model, table).withColumn("model", F.lit(kind))
    assert metrics.auc_by(scored).first().auc > 0.85
    assert set(scored.columns) >= {"pred", "predicted"} and "probability" not in scored.columns
    top = explain.top_importance(models.importances(model, NAMES, spark), 1).first()
    assert top.feature == "A: last"
    _, grid = models.grid_search(table, NAMES, kind, 2, space)
    assert grid.agg(F.max("score")).first()[0] > 0.8


def test_logistic_elimination(table):
    _, kept, wald = models.logistic_elimination(table, NAMES)
    rows = {r.variable: r for r in wald.collect()}
    assert "A: last" in kept and all(r.p_value < 0.1 for r in rows.values())
    assert rows["A: last"].coefficient > 0
    assert models.wald_table(wald).first().variable == "A: last"


def test_logistic_scorer(spark, table, tmp_path):
    """Saved and loaded, it scores raw rows; its residuals are orthogonal to what it uses; missing values are the mean."""
    rows = table.withColumn("flat", F.lit(2.0)).withColumn("raw: count", F.col("n_b") * 1.0)
    names = [*NAMES, "flat", "raw: count"]
    model, wald = models.fit_logistic(rows, names, ["A: last"], ["raw: count"])
    model.write().save(f"{tmp_path}/lr")
    scored = models.score(PipelineModel.load(f"{tmp_path}/lr"), rows)
    assert set(scored.columns) == {*rows.columns, "pred", "predicted"}
    assert all(r.p_value < 0.1 for r in wald.collect())
    used = {r.variable: r.coefficient for r in wald.collect()}
    frame = scored.toPandas()
    value = {f: frame[f].astype(float) if f in ("A: last", "raw: count") else np.log1p(frame[f].astype(float)) for f in names}
    scaled = {f: v if f == "raw: count" else (v - v.mean()) / v.std() for f, v in value.items() if f != "flat"}
    linear = sum(c * (scaled[v] if v != "intercept" else 1) for v, c in used.items())
    assert np.allclose(1 / (1 + np.exp(-linear)), frame.pred)
    off = frame.label - frame.pred
    assert all(abs((off * (scaled[v] if v != "intercept" else 1)).sum()) < 1e-4 for v in used)
    assert ((frame.pred >= .5) == (frame.predicted == 1)).all()
    gap = models.score(model, rows.limit(1).withColumn("A: last", F.lit(None).cast("double"))).first()
    assert 0 < gap.pred < 1


def test_logistic_without_variables(spark, table):
    """Noise drops out, and the intercept alone is left: its score is the share of label 1."""
    noise = table.withColumn("x", F.xxhash64("csn") / 2.0**63).withColumn("label", (F.col("csn") % 4 == 0).cast("int"))
    rate = noise.agg(F.avg("label")).first()[0]
    for model, wald in (models.fit_logistic(noise, ["x"], ["x"], level=1e-6), models.logistic_elimination(noise, ["x"], 1e-6)[::2]):
        row = wald.collect()
        assert [r.variable for r in row] == ["intercept"]
        assert row[0].coefficient == pytest.approx(math.log(rate / (1 - rate)))
        assert models.score(model, noise).agg(F.min("pred"), F.max("pred")).first() == pytest.approx((rate, rate))


def test_stop_round():
    assert models.stop_round([1.0, .9, .8, .7, .6, .5]) is None
    assert models.stop_round([1.0] * 9) == 6  # five losses count, the sixth is no gain
    assert models.stop_round([1.0, .5, .6, .6, .6, .6, .6]) == 7  # the first loss counts until the sixth takes its place
    assert models.stop_round([3.0, 2.0], patience=1, gain=2.0) == 2
    assert models.stop_round([]) is None


def test_boosting_with_patience(spark, table):
    estimator = models.PatientBoosting(labelCol="label", featuresCol="features", seed=42, maxDepth=4, stepSize=0.5, maxIter=60)
    model, losses = models.patient_boosting(table, NAMES, estimator)
    found = losses.orderBy("round").collect()
    stop = models.stop_round([r.loss for r in found])
    assert stop and stop < 60 and [r.round for r in found if r.kept] == list(range(1, stop + 1))
    boosted = model.stages[-1]
    assert boosted.getNumTrees == stop
    held = assembler_rows(table).where("held_out")
    assert boosted.evaluateEachIteration(held)[-1] == pytest.approx(found[stop - 1].loss)


def test_boosting_is_cut_not_fitted_again(table, monkeypatch):
    """The model cut at the stop is the fit to just that many rounds; the losses told go to the next of 16, 32, ... rounds."""
    estimator = models.PatientBoosting(labelCol="label", featuresCol="features", seed=42, maxDepth=3, stepSize=0.3, maxIter=40)
    rows, fits = assembler_rows(table).coalesce(1).cache(), []
    plain = models.GBTClassifier._fit
    monkeypatch.setattr(models.GBTClassifier, "_fit", lambda self, df: fits.append(self.getMaxIter()) or plain(self, df))
    model = estimator.fit(rows)
    stop = model.getNumTrees
    assert fits in ([25], [25, 40]) and stop not in fits and model.getMaxIter() == stop
    assert len(estimator.last_losses) == (16 if stop <= 16 else 32)
    again = plain(estimator.copy({estimator.maxIter: stop}), rows.where("NOT held_out"))
    trees = lambda m: m.toDebugString.split("\n", 1)[1]
    assert trees(model) == trees(again) and model.featureImportances == again.featureImportances
    assert model.evaluateEachIteration(rows) == again.evaluateEachIteration(rows)


def assembler_rows(table):
    rows = models.with_held_out(table).select("csn", "held_out", F.col("label").cast("double").alias("label"),
                                              *[F.col(f"`{f}`").cast("double").alias(f) for f in NAMES])
    return models.assembler(NAMES).transform(rows)


def test_recursive_elimination_keeps_fewer_each_step(table):
    steps = models.recursive_elimination(table, NAMES, models.fixed_gradient_boosting(3)).groupBy("step").count() \
        .orderBy("step").toPandas()
    assert list(steps["count"]) == [4, 3, 2, 1]
    judged = models.recursive_elimination(table, NAMES, models.fixed_gradient_boosting(3), table).orderBy("step").toPandas()
    assert sorted(set(judged.step)) == [0, 1, 2, 3, 4] and judged.feature.isna().sum() == 1
    assert judged.auc.between(0.8, 1).all() and judged.groupby("step").auc.nunique().max() == 1


def test_models_score_rows_once(table):
    """Reports read written scores, so that their several passes do not score the rows again."""
    split = table.withColumn("group", F.when(F.col("csn") % 2 == 0, "train").otherwise("test"))
    forest = models.fit(split, NAMES, models.random_forest(numTrees=3, maxDepth=3))
    report = modelling.evaluate(forest, "rf", split)
    steps = models.recursive_elimination(split, NAMES, models.random_forest(numTrees=3, maxDepth=3), split, shares=(0.4, 0.0))
    for found in (report, steps):
        assert "UDF" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {r.group: r.auc for r in metrics.model_report(
        models.score(forest, split).select(F.lit("rf").alias("model"), "group", "label", "pred")).collect()}
    assert {r.group: r.auc for r in report.collect()} == pytest.approx(want)


def test_partial_dependence(table):
    model = models.fit(table, NAMES, models.random_forest(numTrees=5, maxDepth=3))
    for background in (True, False):
        pd_table = explain.partial_dependence(model, table, NAMES, ["A: last", "n_b"], 4, 5, background).toPandas()
        assert len(pd_table) == 3 * 16 and pd_table.pred.between(0, 1).all()
        cells = pd_table[(pd_table.f1 == "A: last") & (pd_table.f2 == "n_b")].set_index("pixel_index").pred
        # The first feature's position is the slow one.
        assert cells[[12, 13, 14, 15]].mean() > cells[[0, 1, 2, 3]].mean() + 0.3
    ranges = {r.feature: r for r in explain.feature_ranges(table, NAMES).collect()}
    flag = table.agg(F.avg("s>>>c")).first()[0]
    assert (ranges["s>>>c"].lo, ranges["s>>>c"].hi) == (0.0, 1.0) and ranges["s>>>c"].center == pytest.approx(flag)


def test_training_job(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/enc.parquet")
    save_features(spark, NAMES, f"{tmp_path}/features")
    args = train.parse_args(["-f", f"{tmp_path}/enc.parquet", "-v", f"{tmp_path}/features", "-o", f"{tmp_path}/out",
                             "-k", "2", "-n", "1", "-m", "rf"])
    train.run(spark, args, {"numTrees": [5], "maxDepth": [3]})
    model, saved = load_model(spark, f"{tmp_path}/out/rf")
    assert saved["n_iter"] == 1 and load_features(spark, saved["features"]) == NAMES
    assert models.score(model, table).where("pred between 0 and 1").count() == 400
    report = spark.read.parquet(f"{tmp_path}/out/rf_report").toPandas()
    assert set(report.group) == {"train", "test"} and report.auc.min() > 0.8


def test_shared_folder_is_new_each_time(spark):
    assert shared_dir(spark) != shared_dir(spark)


@pytest.fixture
def asked(table, monkeypatch):
    """What a registered query asks of the fits: its estimator, or the arguments of its search."""
    calls = []
    split = table.withColumn("group", F.when(F.col("csn") % 2 == 0, "train").otherwise("test"))
    monkeypatch.setattr(queries, "_training", lambda spark, sf: (split, NAMES))
    monkeypatch.setattr(models, "fit", lambda df, features, estimator: calls.append(estimator))
    monkeypatch.setattr(modelling, "evaluate", lambda model, name, table: None)
    monkeypatch.setattr(models, "_search", lambda df, features, estimator, points, evaluator, k_cv, *rest:
                        (None, calls.append((estimator, points, k_cv))))
    return calls


def test_fixed_boosting_has_all_rounds(asked):
    queries.QUERIES["ml_gb_fixed"](None, None)
    boosting, = asked
    assert (boosting.getMaxIter(), boosting.getMaxDepth(), boosting.getSubsamplingRate()) == (100, 3, 0.9)


def test_fixed_forest_has_all_trees(asked):
    queries.QUERIES["ml_rf_fixed"](None, None)
    forest, = asked
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getImpurity()) == (200, 30, "entropy")


def test_boosting_search_has_the_whole_space(asked):
    """Three draws and five folds, from ensembles long enough for the rule to stop them."""
    queries.QUERIES["ml_gb_search"](None, None)
    (_, points, k_cv), = asked
    assert points == models.sample_space(models.GB_SEARCH, 3) and k_cv == 5
    assert all(p["maxIter"] > 10 * models.PATIENCE for p in points)


def test_forest_grid_is_whole(asked):
    queries.QUERIES["ml_rf_grid"](None, None)
    (_, points, k_cv), = asked
    assert points == models.full_grid(models.RF_GRID) and len(points) == 216 and k_cv == 5


def test_nested_forests_fit_once(table, monkeypatch):
    """Each point gets a forest of its own size, the first trees of the largest one; the fit of a point alone is plain."""
    rows, fits = assembler_rows(table).coalesce(1).cache(), []
    plain = models.RandomForestClassifier._fit
    monkeypatch.setattr(models.RandomForestClassifier, "_fit", lambda self, df: fits.append(self.getNumTrees()) or plain(self, df))
    nested = models.NestedForests(labelCol="label", featuresCol="features", seed=42)
    points = models._param_maps(nested, models.full_grid({"numTrees": [2, 5, 3], "maxDepth": [2, 30, None]}))
    found = dict(nested.fitMultiple(rows, points))
    assert fits == [5, 5] and sorted(found) == list(range(9))
    assert [found[i].getNumTrees for i in range(9)] == [2] * 3 + [5] * 3 + [3] * 3
    trees = lambda m: [t.toDebugString.split("\n", 1)[1] for t in m.trees]
    whole = trees(plain(nested.copy({**points[1], nested.numTrees: 5}), rows))
    for i, n in ((1, 2), (2, 2), (4, 5), (7, 3)):
        assert trees(found[i]) == whole[:n] and found[i].transform(rows).where("probability IS NOT NULL").count() == 400
    assert all(found[i].trees[0].depth <= 2 for i in (0, 3, 6))
