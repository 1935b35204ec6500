"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: input folder; BENCH_CPUS: local cores; BENCH_QUERIES: comma list to run instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import time

from hindcast.operators import explain, models, resample
from hindcast.queries import MODELS, QUERIES, _small_forest
from hindcast.session import local_session
from hindcast.sources import clinical

HEADLINE = (
    "asof_labs", "lab_features", "stage_features", "comorbidity_features", "dx_codes", "feature_matrix",
    "split_patients", "split_patients_exact", "stratified_folds", "quantiles", "corr_pairs", "fs_mutual_info",
    "auc_by_model", "threshold_sweep_gt", "performance_sweep", "subgroup_categorical", "subgroup_numeric",
    "calibration", "survival_curve", "survival_multi_cut", "bootstrap_compare", "bootstrap_compare_poisson",
    "bootstrap_compare_poisson_1000", "bootstrap_compare_10000", "ml_rf_search", "partial_dependence",
    "partial_dependence_28_pairs")


def compare(replicates, method):
    return lambda spark, sf: resample.bootstrap_compare(clinical.scores(spark, sf), MODELS, replicates, method=method)


def dependence(top, rows):
    def run(spark, sf):
        model, table, names = _small_forest(spark, sf)
        best = explain.top_importance(models.importances(model, names, spark), top).collect()
        return explain.partial_dependence(model, table, names, [r.feature for r in best], 10, rows)

    return run


# The names of earlier rounds keep their sizes; the full sizes have names of their own.
SIZED = {"bootstrap_compare": compare(200, "exact"), "bootstrap_compare_poisson": compare(200, "poisson"),
         "bootstrap_compare_poisson_1000": compare(1000, "poisson"), "bootstrap_compare_10000": compare(10_000, "exact"),
         "partial_dependence": dependence(3, 20), "partial_dependence_28_pairs": dependence(7, 100)}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="20g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = {**QUERIES, **SIZED}
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    # One small query first: starting the JVM's threads and reading the first file is not what is measured.
    queries["auc_by_model"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}), flush=True)


if __name__ == "__main__":
    main()
