"""Fitting, searching, scoring and describing risk models with Spark ML."""

from __future__ import annotations

import json
import logging
import math
import random
import threading
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import product, zip_longest
from statistics import NormalDist

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.draws import uniform
from hindcast.functions.scalars import quoted
from hindcast.operators.metrics import model_report
from hindcast.operators.sampling import stratified_folds
from hindcast.operators.selection import normalisation_stats
from hindcast.session import materialize

log = logging.getLogger(__name__)

MAX_DEPTH = 30  # Spark's limit; deeper or unlimited depths are set to it.
DEPTHS = [5 * i for i in range(1, 21)] + [None]
TREES = [10 + 110 * i for i in range(10)]

# Search spaces by parameter name. Splits are limited by leaf size only: Spark has no least number of rows to split.
RF_SEARCH = {"numTrees": TREES, "featureSubsetStrategy": ["sqrt"], "maxDepth": DEPTHS,
             "minInstancesPerNode": [1, 2, 4]}
GB_SEARCH = {"featureSubsetStrategy": ["sqrt"], "maxDepth": DEPTHS, "minInstancesPerNode": [1, 2, 4],
             "maxIter": TREES, "subsamplingRate": [0.5, 0.8, 1.0],
             "stepSize": [0.01 + i * (0.2 - 0.01) / 9 for i in range(10)]}
RF_GRID = {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30, None], "minInstancesPerNode": [1, 2, 4],
           "featureSubsetStrategy": ["sqrt", "log2", "all"], "bootstrap": [True, False]}
GB_GRID = {"stepSize": [0.01, 0.05, 0.1], "maxIter": [100, 200, 300], "subsamplingRate": [0.8, 0.9, 1.0],
           "maxDepth": [3, 5, 7], "minInstancesPerNode": [1, 2], "featureSubsetStrategy": ["sqrt", "log2", "all"]}


PATIENCE, GAIN, HELD_OUT, FIRST_ROUNDS = 5, 1e-4, 0.1, 25


def stop_round(losses: Sequence[float], patience: int = PATIENCE, gain: float = GAIN) -> int | None:
    """The round (from 1) at which boosting stops: the first whose loss is not ``gain`` below one of the ``patience``
    losses that count before it. None if there is none. A loss that is takes the place of the oldest."""
    counted = [math.inf] * patience
    for i, loss in enumerate(losses):
        if not any(loss + gain < c for c in counted):
            return i + 1
        counted[i % patience] = loss
    return None


class PatientBoosting(GBTClassifier):
    """Boosting that stops after ``patience`` rounds without gain on the rows whose ``held_out`` is true, which it does not fit.

    The ensemble is fitted to FIRST_ROUNDS rounds, then four times as many and so on up to ``maxIter``, and the held-out loss
    of every round read from it, until the stop is among them. Rounds do not depend on those that follow, so the model is
    that ensemble without the rounds after the stop; nothing is fitted again. ``last_losses`` keeps the losses of the first
    16, 32, ... rounds, up to the first of these numbers that is not below the stop.
    """

    held_out = "held_out"
    patience, gain = PATIENCE, GAIN

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        fitted_on, judged_on = dataset.where(~F.col(self.held_out)), dataset.where(F.col(self.held_out))
        most, rounds = self.getMaxIter(), min(FIRST_ROUNDS, self.getMaxIter())
        while True:
            model = GBTClassifier._fit(self.copy({self.maxIter: rounds}), fitted_on)
            losses = model.evaluateEachIteration(judged_on)
            stop = stop_round(losses, self.patience, self.gain)
            if stop is not None or rounds == most:
                break
            rounds = min(4 * rounds, most)
        told = 16
        while told < (stop or rounds):
            told *= 2
        self.last_losses = losses[:told]
        return model if stop is None or stop == rounds else cut_rounds(model, stop)


def cut_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The boosted model's first ``rounds`` trees, as a model with the same parameters."""
    jvm, whole = SparkSession.active().sparkContext._jvm, model._java_obj
    trees = JavaWrapper._new_java_array(list(whole.trees())[:rounds], jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel)
    weights = JavaWrapper._new_java_array(list(whole.treeWeights())[:rounds], jvm.double)
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        whole.uid(), trees, weights, whole.numFeatures(), whole.numClasses())
    whole.copyValues(cut, jvm.org.apache.spark.ml.param.ParamMap.empty())
    return model._copyValues(GBTClassificationModel(cut), {model.maxIter: rounds})


class NestedForests(RandomForestClassifier):
    """A forest that, given many points, fits those which differ in their number of trees once, with the largest number.

    Trees of a forest do not depend on one another, so its first trees are a forest of that many trees; nothing is fitted
    again. Points that are alike (depths beyond the limit) share a model too.
    """

    at_a_time = 4  # forests that are fitted side by side; about as many are held

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]) -> Iterator[tuple[int, RandomForestClassificationModel]]:
        groups: dict[tuple, list[int]] = {}
        for i, point in enumerate(paramMaps):
            groups.setdefault(tuple(sorted((p.name, v) for p, v in point.items() if p.name != "numTrees")), []).append(i)
        sizes = [point.get(self.numTrees, self.getNumTrees()) for point in paramMaps]
        waves, nested = [list(groups.values())[i:i + self.at_a_time] for i in range(0, len(groups), self.at_a_time)], self.copy()

        class Models:
            """Hands out each point once, to any thread. The points of one forest wait for its fit and then take their trees."""

            def __init__(self):
                self.left = iter([(i, members) for wave in waves for row in zip_longest(*wave)
                                  for i, members in zip(row, wave, strict=True) if i is not None])
                self.lock, self.locks = threading.Lock(), {members[0]: threading.Lock() for members in groups.values()}
                self.fitted, self.to_come = {}, {members[0]: len(members) for members in groups.values()}

            def __iter__(self):
                return self

            def __next__(self) -> tuple[int, RandomForestClassificationModel]:
                with self.lock:
                    i, members = next(self.left)
                first = members[0]
                with self.locks[first]:
                    if first not in self.fitted:
                        most = {nested.numTrees: max(sizes[j] for j in members)}
                        self.fitted[first] = nested.fit(dataset, {**paramMaps[first], **most})
                    model = self.fitted[first]
                    self.to_come[first] -= 1
                    if not self.to_come[first]:
                        del self.fitted[first]
                return i, cut_trees(model, sizes[i])

        return Models()


def cut_trees(model: RandomForestClassificationModel, trees: int) -> RandomForestClassificationModel:
    """The forest's first ``trees`` trees, as a model with the same parameters."""
    jvm, whole = SparkSession.active().sparkContext._jvm, model._java_obj
    some = JavaWrapper._new_java_array(list(whole.trees())[:trees], jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel)
    cut = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        whole.uid(), some, whole.numFeatures(), whole.numClasses())
    whole.copyValues(cut, jvm.org.apache.spark.ml.param.ParamMap.empty())
    smaller = model._copyValues(RandomForestClassificationModel(cut), {model.numTrees: trees})
    smaller._transfer_params_to_java()
    return smaller


def with_held_out(df: DataFrame, key: str = "csn", share: float = HELD_OUT, seed: int = 7) -> DataFrame:
    """Add ``held_out``: a share of the rows, by a hash of their key."""
    return df.withColumn("held_out", uniform(seed, key) < share)


def patient_boosting(df: DataFrame, features: Sequence[str], estimator: PatientBoosting | None = None, key: str = "csn"
                     ) -> tuple[PipelineModel, DataFrame]:
    """A boosted model with early stop, and (round, loss, kept): the held-out loss per round and whether the model has it."""
    estimator = estimator or PatientBoosting(labelCol="label", featuresCol="features", seed=42, subsamplingRate=0.9,
                                             maxDepth=3, maxIter=100)
    rows = with_held_out(df, key).select(F.col(key), "held_out", F.col("label").cast("double").alias("label"),
                                         *[F.col(quoted(f)).cast("double").alias(f) for f in features])
    prepared = materialize(assembler(features).transform(rows).select(key, "held_out", "label", "features"), key)
    model = estimator.fit(prepared)
    losses = [(i + 1, float(x), i < model.getNumTrees) for i, x in enumerate(estimator.last_losses)]
    return PipelineModel([assembler(features), model]), \
        df.sparkSession.createDataFrame(losses, "round int, loss double, kept boolean")


def random_forest(**params) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="label", featuresCol="features", seed=42, **params)


def gradient_boosting(**params) -> GBTClassifier:
    return GBTClassifier(labelCol="label", featuresCol="features", seed=42, **params)


def fixed_random_forest() -> RandomForestClassifier:
    return random_forest(numTrees=200, impurity="entropy", maxDepth=MAX_DEPTH)


def fixed_gradient_boosting(max_iter: int = 100) -> GBTClassifier:
    """``max_iter`` takes the place of a callback that stops the fit."""
    return gradient_boosting(subsamplingRate=0.9, maxIter=max_iter, maxDepth=3)


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def _param_maps(estimator, points: Sequence[Mapping[str, object]]) -> list[dict]:
    maps = []
    for point in points:
        depth = point.get("maxDepth", MAX_DEPTH)
        if depth is None or depth > MAX_DEPTH:
            log.info("maxDepth %s is set to %d", depth, MAX_DEPTH)
            depth = MAX_DEPTH
        values = {**point, "maxDepth": depth}
        maps.append({estimator.getParam(k): v for k, v in values.items()})
    return maps


def sample_space(space: Mapping[str, Sequence], n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` different points of a grid, drawn without writing the grid out."""
    names, total = list(space), 1
    for values in space.values():
        total *= len(values)
    points = []
    for number in random.Random(seed).sample(range(total), min(n_iter, total)):
        point = {}
        for name in names:
            number, at = divmod(number, len(space[name]))
            point[name] = space[name][at]
        points.append(point)
    return points


def full_grid(space: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(space, values, strict=True)) for values in product(*space.values())]


CLASSES = {"ml_attr": {"type": "nominal", "name": "label", "vals": ["0", "1"]}}


def _search(df: DataFrame, features: Sequence[str], estimator, points: Sequence[Mapping], evaluator: Evaluator,
            k_cv: int, parallelism: int, key: str) -> tuple[PipelineModel, DataFrame]:
    """Cross-validate every point on label-stratified folds and refit the best on all rows.

    The assembled rows with their folds are written once; all fits read that copy.
    """
    table = df.select(F.col(key), F.col("label").cast("double").alias("label"),
                      *[F.col(quoted(f)).cast("double").alias(f) for f in features])
    folds = stratified_folds(table, k_cv, 42, "label", key)
    # A boosting fit holds rows out to decide when to stop. The label's metadata name its classes, which a fit would count.
    held_out = ["held_out"] if isinstance(estimator, PatientBoosting) else []
    vectors = assembler(features).transform(with_held_out(folds, key) if held_out else folds).select(
        key, F.col("label").alias("label", metadata=CLASSES), "features", "fold", *held_out)
    prepared = materialize(vectors, key).drop(key)
    maps = _param_maps(estimator, points)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=k_cv,
                        foldCol="fold", parallelism=parallelism)
    fitted: CrossValidatorModel = cv.fit(prepared)
    rows = [(i, json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(score))
            for i, (m, score) in enumerate(zip(maps, fitted.avgMetrics, strict=True))]
    results = df.sparkSession.createDataFrame(rows, "draw int, params string, score double")
    return PipelineModel([assembler(features), fitted.bestModel]), results


def random_search(df: DataFrame, features: Sequence[str], kind: str, n_iter: int = 3, k_cv: int = 5,
                  space: Mapping[str, Sequence] | None = None, parallelism: int = 4, key: str = "csn"
                  ) -> tuple[PipelineModel, DataFrame]:
    """Random search by ROC AUC: kind ``rf`` or ``gb``. Boosting stops after PATIENCE rounds without gain on held-out rows."""
    if kind == "rf":
        estimator, default = random_forest(), RF_SEARCH
    elif kind == "gb":
        estimator = PatientBoosting(labelCol="label", featuresCol="features", seed=42)
        default = GB_SEARCH
    else:
        raise ValueError(f"unknown model type {kind}")
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    return _search(df, features, estimator, sample_space(space or default, n_iter), evaluator, k_cv, parallelism, key)


def grid_search(df: DataFrame, features: Sequence[str], kind: str, k_cv: int = 5,
                space: Mapping[str, Sequence] | None = None, parallelism: int = 4, key: str = "csn"
                ) -> tuple[PipelineModel, DataFrame]:
    """Full grid search by accuracy: kind ``rf`` or ``gb``. Forests that differ in their number of trees share their trees."""
    nested = NestedForests(labelCol="label", featuresCol="features", seed=42)
    estimator, default = {"rf": (nested, RF_GRID), "gb": (gradient_boosting(), GB_GRID)}[kind]
    evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    return _search(df, features, estimator, full_grid(space or default), evaluator, k_cv, parallelism, key)


def fit(df: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    data = df.select(F.col("label").cast("double").alias("label"),
                     *[F.col(quoted(f)).cast("double").alias(f) for f in features])
    return Pipeline(stages=[assembler(features), estimator]).fit(data)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``pred``, the probability of class 1, and ``predicted``, the hard class; for trees and logistic models."""
    out = model.transform(df)
    internal = ["features", "rawPrediction", "probability", "prediction", "_pred", *[c for c in out.columns if c.startswith("_z")]]
    if "_pred" in out.columns:
        added = {"pred": F.col("_pred"), "predicted": (F.col("_pred") >= 0.5).cast("int")}
    else:
        added = {"pred": vector_to_array("probability")[1], "predicted": F.col("prediction").cast("int")}
    return out.withColumns(added).drop(*internal)


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance): one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)],
                                 "feature string, importance double")


def recursive_elimination(df: DataFrame, features: Sequence[str], estimator=None, test: DataFrame | None = None,
                          shares: Sequence[float] = (0.8, 0.6, 0.4, 0.2, 0.0), cap: int = 20) -> DataFrame:
    """Refit on ever fewer features: (step, n_features, feature, importance) of the features kept after each step, and with
    ``test`` rows the AUC, average precision, TPR and specificity of the step's model on all of them.

    A step keeps the best ``int(share * all)`` features, but at most ``cap``; a step that keeps none ends it, with a row of
    its metrics only. The steps' scores are one long table, written once and judged in one job.
    """
    spark, kept, rows, scored = df.sparkSession, list(features), [], []
    data = materialize(df.select("label", *[F.col(quoted(f)) for f in features]))
    judged = None if test is None else materialize(test.select("label", *[F.col(quoted(f)) for f in features]))
    for step, share in enumerate(shares):
        size = min(int(len(features) * share), cap)
        if size == 0 and judged is None:
            break
        model = fit(data, kept, estimator or fixed_gradient_boosting())
        if judged is not None:
            scored.append(score(model, judged).select(F.lit(step).alias("step"), "label", "pred"))
        values = model.stages[-1].featureImportances.toArray()
        ranked = sorted(zip(kept, values, strict=True), key=lambda fv: (-fv[1], fv[0]))
        rows += [(step, len(kept), f, float(v)) for f, v in ranked[:size]] or [(step, len(kept), None, None)]
        kept = [f for f, _ in ranked[:size]]
        if not kept:
            break
    out = spark.createDataFrame(rows, "step int, n_features int, feature string, importance double")
    if not scored:
        return out
    long = materialize(reduce(DataFrame.unionByName, scored))
    report = model_report(long.select(F.col("step").cast("string").alias("model"), F.lit("test").alias("group"), "label", "pred"))
    return out.join(report.withColumn("step", F.col("model").cast("int")).drop("model", "group"), "step")


WALD = "variable string, coefficient double, std_error double, t_value double, p_value double"


def _intercept_only(data: DataFrame) -> list[tuple]:
    """The Wald row of a model without variables: the log odds of the label."""
    n, positives = data.agg(F.count(F.lit(1)), F.sum("label")).first()
    rate = positives / n
    odds, error = math.log(rate / (1 - rate)), 1 / math.sqrt(n * rate * (1 - rate))
    return [("intercept", odds, error, odds / error, 2 * NormalDist().cdf(-abs(odds / error)))]


def _eliminate(data: DataFrame, inputs: Mapping[str, str], level: float):
    """Fits on ``inputs`` (variable to column), dropping all with p >= ``level`` at once until their number is stable.

    The intercept is a variable like the others. When no variable is left, the model is the intercept alone. Returns the
    fitted stage (None for the intercept alone), its variables and its Wald rows.
    """
    kept, intercept = list(inputs), True
    while kept:
        glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="label", fitIntercept=intercept,
                                          featuresCol="features", predictionCol="_pred", tol=1e-10, maxIter=50)
        fitted = glm.fit(assembler([inputs[v] for v in kept]).transform(data))
        names = kept + (["intercept"] if intercept else [])
        values = list(fitted.coefficients) + ([fitted.intercept] if intercept else [])
        stats = fitted.summary
        table = [(v, float(c), float(s), float(t), float(p)) for v, c, s, t, p in zip(
            names, values, stats.coefficientStandardErrors, stats.tValues, stats.pValues, strict=True)]
        passed = {r[0] for r in table if r[4] < level}
        if len(passed) == len(table):
            return fitted, kept, table
        kept, intercept = [v for v in kept if v in passed], "intercept" in passed
    return None, [], _intercept_only(data)


def logistic_elimination(df: DataFrame, features: Sequence[str], level: float = 0.1
                         ) -> tuple[PipelineModel, list[str], DataFrame]:
    """Logistic regression with elimination by p-value on variables that are scaled already.

    Returns the last model, its features and its Wald table (variable, coefficient, std_error, t_value, p_value).
    """
    data = materialize(df.select(F.col("label").cast("double").alias("label"),
                                 *[F.col(quoted(f)).cast("double").alias(f) for f in features]))
    fitted, kept, table = _eliminate(data, {f: f for f in features}, level)
    wald = df.sparkSession.createDataFrame(table, WALD)
    stages = [assembler(kept), fitted] if fitted else [_constant(table)]
    return PipelineModel(stages), kept, wald


def _constant(table: list[tuple]) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, {1 / (1 + math.exp(-table[0][1]))!r}D AS _pred FROM __THIS__")


def fit_logistic(train: DataFrame, features: Sequence[str], no_log: Sequence[str] = (), unscaled: Sequence[str] = (),
                 level: float = 0.1) -> tuple[PipelineModel, DataFrame]:
    """A logistic model that scores any frame with the raw columns, and its Wald table.

    The saved pipeline holds the train rows' means and deviations (of log(x + 1), for variables outside ``no_log``), the
    scaled columns and the coefficients. Variables in ``unscaled`` are taken as they are; those without spread on the train
    rows are left out. A missing value counts as the train mean (0 for ``unscaled`` ones).
    """
    scaled = [f for f in features if f not in unscaled]
    stats = {r.feature: (r["mean"], r["std"]) for r in normalisation_stats(train, scaled, no_log).collect()} if scaled else {}
    inputs, parts = {}, []
    for i, f in enumerate(features):
        value = f"CAST({quoted(f)} AS DOUBLE)"
        if f not in unscaled:
            mean, std = stats[f]
            if not std:
                continue
            value = f"(({value if f in no_log else f'log1p({value})'}) - {mean!r}D) / {std!r}D"
        inputs[f] = f"_z{i}"
        parts.append(f"coalesce({value}, 0D) AS _z{i}")
    scale = SQLTransformer(statement=", ".join(["SELECT *", *parts]) + " FROM __THIS__")
    data = materialize(scale.transform(train).select(F.col("label").cast("double").alias("label"), *inputs.values()))
    fitted, kept, table = _eliminate(data, inputs, level)
    stages = [scale, assembler([inputs[v] for v in kept]), fitted] if fitted else [_constant(table)]
    return PipelineModel(stages), train.sparkSession.createDataFrame(table, WALD)


def wald_table(wald: DataFrame) -> DataFrame:
    return wald.select("variable", "t_value", "p_value").orderBy("p_value", "variable")
