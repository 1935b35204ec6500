"""Encounter tables ready for model fitting, and the evaluation of fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalars import quoted
from hindcast.operators.asof import ENCOUNTER_KEY
from hindcast.operators.features import lab_and_stage_features
from hindcast.operators.metrics import model_report
from hindcast.operators.models import score
from hindcast.operators.sampling import sample_one, split_patients
from hindcast.session import materialize


def encounter_features(encounters: DataFrame, labs: DataFrame, stage: DataFrame, tests: Sequence[str],
                       sites: Sequence[str], specialties: Sequence[str],
                       lab_order: Sequence[str] = ("result_time",)) -> DataFrame:
    """One row per encounter with columns named by kind: ``<test>: last``, ``<test>: count``, ``n_<site>``,
    ``specialty>>><value>``. The names are what later steps select by."""
    seen = lab_and_stage_features(encounters, labs, stage, tests, {"body_site_name": sites}, lab_order,
                                  {"body_site_name": "n_"})
    lab_cols = [F.col(quoted(f"{t}_{part}")).alias(f"{t}: {name}") for t in tests
                for part, name in (("MOST_RECENT_VALUE", "last"), ("COUNT", "count"))]
    key = list(ENCOUNTER_KEY)
    joined = encounters.withColumn("appt_date", F.to_date("appt_time")) \
        .join(seen.select(*key, *lab_cols, *[F.col(quoted(f"n_{s}")) for s in sites]), key, "left")
    numeric = [f"{t}: {n}" for t in tests for n in ("last", "count")] + [f"n_{s}" for s in sites]
    filled = joined.na.fill(0, subset=numeric)
    flags = [F.coalesce((F.col("specialty") == F.lit(v)).cast("int"), F.lit(0)).alias(f"specialty>>>{v}")
             for v in specialties]
    return filled.select("*", *flags)


def draw_cohort(encounters: DataFrame, seed: int = 123456, prop_train: float = 0.7) -> DataFrame:
    """One random encounter per patient, tagged ``group`` train or test by patient."""
    return split_patients(sample_one(encounters, seed), seed, prop_train)


def evaluate(model: PipelineModel, name: str, table: DataFrame, keep: Sequence[str] = ("csn", "label", "group")
             ) -> DataFrame:
    """AUC, average precision, TPR and specificity of a model per split. Rows are scored once and their scores written."""
    return model_report(materialize(score(model, table).select(F.lit(name).alias("model"), *keep, "pred")))


