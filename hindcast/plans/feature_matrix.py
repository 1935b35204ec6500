"""From the four source tables to one numeric matrix with a label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.columns import drop_columns, fill_missing
from hindcast.functions.scalars import quoted, recode_flags
from hindcast.operators.asof import ENCOUNTER_KEY
from hindcast.operators.features import comorbidity_features, demographics, lab_features, stage_features


def left_join_features(base: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Left joins on the encounter key; a name that is taken gets the table's suffix."""
    out = base
    for suffix, table in tables.items():
        taken = set(out.columns)
        names = [c if c in ENCOUNTER_KEY or c not in taken else f"{c}{suffix}" for c in table.columns]
        renamed = table.select(*[F.col(quoted(c)).alias(n) for c, n in zip(table.columns, names, strict=True)])
        out = out.join(renamed, list(ENCOUNTER_KEY), "left")
    return out


def feature_matrix(encounters: DataFrame, labs: DataFrame, stage: DataFrame, dx: DataFrame, code_map: DataFrame,
                   tests: Sequence[str], categories: dict[str, Sequence[str]],
                   lab_order: Sequence[str] = ("result_time",), keep_keys: bool = True,
                   strict_flags: bool = False) -> DataFrame:
    """Demographics and ``dead``, then diagnoses, labs and stages; missing is 0, flags are scores."""
    joined = left_join_features(demographics(encounters), {
        "_dx": comorbidity_features(encounters, dx, code_map),
        "_pat": lab_features(encounters, labs, tests, lab_order),
        "_stage": stage_features(encounters, stage, categories)})
    filled = recode_flags(fill_missing(joined), strict=strict_flags)
    return drop_columns(filled, () if keep_keys else ENCOUNTER_KEY)
