"""From raw tables to a judged model: ``spark-submit -m hindcast.plans.raw_report -i RAW -o OUT -m rf``.

RAW holds the folders ``patients``, ``labs``, ``stages``, ``diagnoses`` and ``codes`` as CSV with a header (or Parquet, under
names that end in ``.parquet``). Schemas are given, dates of death are read leniently, and the stage categories are those that
the table holds.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.operators.asof import ENCOUNTER_KEY
from hindcast.operators.explain import bottom_importance, cumulative_importance, top_importance
from hindcast.operators.features import discover_categories
from hindcast.operators.metrics import model_report, threshold_sweep_ge
from hindcast.operators.models import grid_search, importances, random_search, score
from hindcast.operators.sampling import label_rates, split_patients, split_rows
from hindcast.plans.feature_matrix import feature_matrix
from hindcast.session import materialize
from hindcast.sources.clinical import LAB_TESTS
from hindcast.sources.tables import DIAGNOSES, LABS, PATIENTS, STAGES, read_table, save_model, write_table

CODES = T.StructType([T.StructField("code", T.StringType()), T.StructField("comorbidity", T.StringType()),
                      T.StructField("mortality_weight", T.DoubleType()), T.StructField("readmission_weight", T.DoubleType())])
RAW = {"patients": PATIENTS, "labs": LABS, "stages": STAGES, "diagnoses": DIAGNOSES, "codes": CODES}
STAGE_COLUMNS = ("body_site_name", "stage_group")
LAB_ORDER = ("result_time", "ord_num_value", "result_flag")


def read_raw(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    ending = ".parquet" if fmt == "parquet" else ""
    return {name: read_table(spark, f"{folder}/{name}{ending}", schema) for name, schema in RAW.items()}


def training_matrix(raw: Mapping[str, DataFrame], tests: Sequence[str] = LAB_TESTS) -> tuple[DataFrame, list[str]]:
    """One row per patient and date: ``csn`` (its key as text), ``empi``, ``label`` (death on any row), features; their names."""
    found = discover_categories(raw["stages"], STAGE_COLUMNS).orderBy("category", "value").collect()
    categories = {c: [r.value for r in found if r.category == c] for c in STAGE_COLUMNS}
    table = feature_matrix(raw["patients"], raw["labs"], raw["stages"], raw["diagnoses"], raw["codes"], tests, categories,
                           LAB_ORDER)
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    names = [c for c, kind in table.dtypes if c not in (*ENCOUNTER_KEY, "dead") and kind in numeric]
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ENCOUNTER_KEY]).alias("csn")
    return table.select(key, "empi", F.col("dead").alias("label"), *[F.col(f"`{n}`") for n in names]), names


@dataclass
class Report:
    model: PipelineModel
    features: list[str]
    tables: dict[str, DataFrame]  # rates, search, report, sweep, top, bottom, cumulative


def judge(raw: Mapping[str, DataFrame], kind: str = "rf", search: str = "grid", split: str = "rows",
          tests: Sequence[str] = LAB_TESTS, space: Mapping[str, Sequence] | None = None, n_iter: int = 3, k_cv: int = 5) -> Report:
    """Matrix, split (``rows`` or ``patients``), search (``grid`` by accuracy or ``random`` by AUC) on the train rows, and what the
    best model does on both sides: rates, AUC and average precision, metrics at the nine thresholds, importances."""
    matrix, names = training_matrix(raw, tests)
    table = materialize({"rows": split_rows, "patients": split_patients}[split](matrix), "csn")
    train = table.where("group = 'train'")
    if search == "grid":
        model, results = grid_search(train, names, kind, k_cv, space)
    else:
        model, results = random_search(train, names, kind, n_iter, k_cv, space)
    scored = materialize(score(model, table).select("csn", F.lit(kind).alias("model"), "group", "label", "pred"))
    weights = importances(model, names, table.sparkSession)
    return Report(model, names, {
        "rates": label_rates(table), "search": results, "report": model_report(scored),
        "sweep": threshold_sweep_ge(scored.where("group = 'test'")), "top": top_importance(weights),
        "bottom": bottom_importance(weights), "cumulative": cumulative_importance(weights)})


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, space: Mapping | None = None,
         tests: Sequence[str] = LAB_TESTS) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("-i", "--raw", required=True)
    parser.add_argument("-o", "--out", required=True)
    parser.add_argument("-m", "--model-type", choices=["rf", "gb"], default="rf")
    parser.add_argument("-s", "--search", choices=["grid", "random"], default="grid")
    parser.add_argument("--split", choices=["rows", "patients"], default="rows")
    parser.add_argument("--format", choices=["csv", "parquet"], default="csv")
    parser.add_argument("-n", "--n-iter", type=int, default=3)
    parser.add_argument("-k", "--k-cv", type=int, default=5)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("hindcast-report").getOrCreate()
    done = judge(read_raw(spark, args.raw, args.format), args.model_type, args.search, args.split, tests, space, args.n_iter,
                 args.k_cv)
    save_model(spark, done.model, f"{args.out}/{args.model_type}", vars(args) | {"features": done.features})
    for name, table in done.tables.items():
        write_table(table, f"{args.out}/{name}")


if __name__ == "__main__":
    main()
