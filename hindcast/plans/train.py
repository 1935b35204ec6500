"""Training job: ``spark-submit -m hindcast.plans.train -f FEATURES -m rf -o OUT`` and the like."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from hindcast.functions.columns import candidate_features
from hindcast.operators.models import random_search
from hindcast.operators.sampling import label_rates
from hindcast.plans.modelling import evaluate, draw_cohort
from hindcast.session import materialize
from hindcast.sources.tables import load_features, read_table, save_model, write_table


def parse_args(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("-n", "--n-iter", type=int, default=3, help="number of random search draws")
    parser.add_argument("-k", "--k-cv", type=int, default=5, help="number of folds")
    parser.add_argument("-f", "--infile", required=True, help="encounter features, CSV or Parquet")
    parser.add_argument("-m", "--model-type", choices=["rf", "gb"], default="rf")
    parser.add_argument("-v", "--features", help="saved feature list; default: candidates by column name")
    parser.add_argument("-o", "--out", required=True, help="folder for model, search results and report")
    parser.add_argument("-p", "--parallelism", type=int, default=4, help="fits that run at a time")
    return parser.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace, space: dict | None = None) -> None:
    table = read_table(spark, args.infile, overrides={"pat_id": "string"})
    cohort = materialize(draw_cohort(table))
    write_table(label_rates(cohort), f"{args.out}/label_rates")
    features = load_features(spark, args.features) if args.features else candidate_features(table)
    model, results = random_search(cohort.where("group = 'train'"), features, args.model_type, args.n_iter, args.k_cv,
                                   space, args.parallelism)
    save_model(spark, model, f"{args.out}/{args.model_type}", vars(args))
    write_table(results, f"{args.out}/{args.model_type}_search")
    write_table(evaluate(model, args.model_type, cohort), f"{args.out}/{args.model_type}_report")


if __name__ == "__main__":
    run(SparkSession.builder.appName("hindcast-train").getOrCreate(), parse_args())
