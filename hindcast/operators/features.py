"""Feature tables per encounter: labs, staging, diagnoses, demographics, mortality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import age_years, lenient_date, sex_indicator
from hindcast.operators.asof import (
    ENCOUNTER_KEY, daily, encounter_days, event_keys, running_features)
from hindcast.session import materialize


def _last_of_day(value: str, order: Sequence[str]) -> Column:
    """The day's last non-missing value, by a total order of its rows."""
    return F.max_by(F.when(F.col(value).isNotNull(), F.col(value)),
                    F.when(F.col(value).isNotNull(), F.struct(*order, value)))


def daily_labs(labs: DataFrame, tests: Sequence[str], order: Sequence[str] = ("result_time",)) -> DataFrame:
    """One row per patient, day and test: count, last value, last flag."""
    order = [c for c in order if c in labs.columns]
    return daily(labs.where(F.col("common_name").isin(*tests)), "result_time", {
        "n": F.count(F.lit(1)), "value": _last_of_day("ord_num_value", order),
        "flag": _last_of_day("result_flag", order)}, by=["common_name"])


def _lab_inputs(labs: DataFrame, tests: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, dict, dict]:
    """(days, sums, lasts) of the lab tests, for ``running_features``."""
    days = daily_labs(labs, tests, order)
    sums, lasts = {}, {}
    for test in tests:
        mine = F.col("common_name") == F.lit(test)
        lasts[f"{test}_MOST_RECENT_VALUE"] = F.when(mine, F.col("value"))
        lasts[f"{test}_MOST_RECENT_FLAG"] = F.when(mine, F.col("flag"))
        sums[f"{test}_COUNT"] = F.when(mine, F.col("n"))
    return days, sums, lasts


def lab_features(encounters: DataFrame, labs: DataFrame, tests: Sequence[str],
                 order: Sequence[str] = ("result_time",), dedupe_encounters: bool = False) -> DataFrame:
    """Per test: most recent value, most recent flag and count before the encounter.

    Value and flag are each the last that is not missing, so they may stem from different results. A test without
    results is NULL in all three.
    """
    days, sums, lasts = _lab_inputs(labs, tests, order)
    out = running_features(encounters, days, sums=sums, lasts=lasts, dedupe_encounters=dedupe_encounters)
    names = [f"{t}_{part}" for t in tests for part in ("MOST_RECENT_VALUE", "MOST_RECENT_FLAG", "COUNT")]
    return out.select(*ENCOUNTER_KEY, *[f"`{n}`" for n in names])


def lab_last(encounters: DataFrame, labs: DataFrame, tests: Sequence[str],
             order: Sequence[str] = ("result_time",)) -> DataFrame:
    """The same, long: one row per encounter and test with results."""
    wide = lab_features(encounters, labs, tests, order)
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("common_name"), F.col(f"`{t}_MOST_RECENT_VALUE`").alias("last_value"),
                 F.col(f"`{t}_MOST_RECENT_FLAG`").alias("last_flag"), F.col(f"`{t}_COUNT`").alias("n"))
        for t in tests])).alias("r")
    return wide.select(*ENCOUNTER_KEY, rows).select(*ENCOUNTER_KEY, "r.*").where("n is not null")


def _stage_inputs(stage: DataFrame, categories: dict[str, Sequence[str]], prefixes: dict[str, str] | None
                  ) -> tuple[DataFrame, dict]:
    """(days, sums) of the categories, for ``running_features``."""
    prefixes = prefixes or {c: f"{c.upper()}_" for c in categories}
    counts = {f"{prefixes[c]}{v}": F.count_if(F.col(c) == F.lit(v)) for c, values in categories.items() for v in values}
    days = daily(stage, "sign_datetime", counts)
    return days, {k: F.col(f"`{k}`") for k in counts}


def stage_features(encounters: DataFrame, stage: DataFrame, categories: dict[str, Sequence[str]],
                   prefixes: dict[str, str] | None = None, dedupe_encounters: bool = False) -> DataFrame:
    """Per category value, the number of earlier stage rows; a missing category counts in none."""
    days, sums = _stage_inputs(stage, categories, prefixes)
    return running_features(encounters, days, sums=sums, dedupe_encounters=dedupe_encounters)


def lab_and_stage_features(encounters: DataFrame, labs: DataFrame, stage: DataFrame, tests: Sequence[str],
                           categories: dict[str, Sequence[str]], order: Sequence[str] = ("result_time",),
                           prefixes: dict[str, str] | None = None) -> DataFrame:
    """``lab_features`` and ``stage_features`` in one running window: one row per encounter date with either before it.

    Days of labs and of stages are rows of their own in it, in which the others' columns are missing. Both tables have the
    same patient key. A count is NULL, not 0, where its table has no earlier row.
    """
    lab_days, sums, lasts = _lab_inputs(labs, tests, order)
    stage_days, more = _stage_inputs(stage, categories, prefixes)
    days = lab_days.unionByName(stage_days, allowMissingColumns=True)
    return running_features(encounters, days, sums=sums | more, lasts=lasts)


def discover_categories(df: DataFrame, columns: Sequence[str], max_values: int = 1000) -> DataFrame:
    """(category, value, n): the values that occur in each column, missing ones left out, with their counts.

    A dimension table: it becomes columns, so more than ``max_values`` values of all columns together are an error.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in columns]))
    found = df.select(pairs.alias("p")).where("p.value IS NOT NULL").groupBy("p.category", "p.value") \
        .agg(F.count(F.lit(1)).alias("n"))
    found = materialize(found)
    if found.limit(max_values + 1).count() > max_values:
        raise ValueError(f"more than {max_values} different values in {', '.join(columns)}")
    return found


def stage_features_discovered(encounters: DataFrame, stage: DataFrame, columns: Sequence[str],
                              prefixes: dict[str, str] | None = None, max_values: int = 1000,
                              dedupe_encounters: bool = False) -> DataFrame:
    """``stage_features`` for all values that the table holds."""
    rows = discover_categories(stage, columns, max_values).orderBy("category", "value").collect()
    categories = {c: [r.value for r in rows if r.category == c] for c in columns}
    return stage_features(encounters, stage, categories, prefixes, dedupe_encounters)


def dx_code_counts(encounters: DataFrame, dx: DataFrame, dedupe_encounters: bool = False) -> DataFrame:
    """One row per encounter and earlier code, with how often it was seen.

    The running count is kept per (patient, code), so the codes of one patient are spread over tasks.
    """
    keys = event_keys(dx)
    days = daily(dx.where(F.col("code").isNotNull()), "contact_date", {"n": F.count(F.lit(1))}, by=["code"])
    first = days.groupBy(*keys, "code").agg(F.min("event_day").alias("first_day"))
    wanted = encounter_days(encounters).join(first, keys).where(F.col("first_day") < F.col("appt_date"))
    rows = wanted.select(*ENCOUNTER_KEY, "code", "n_enc", F.col("appt_date").alias("day"), F.lit(0).alias("kind")) \
        .unionByName(days.select(*keys, "code", F.col("event_day").alias("day"), F.lit(1).alias("kind"), "n"),
                     allowMissingColumns=True)
    order = Window.partitionBy(*keys, "code").orderBy("day", "kind") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    times = F.lit(1) if dedupe_encounters else F.col("n_enc")
    return (
        rows.select(*ENCOUNTER_KEY, "code", "kind", (F.sum("n").over(order) * times).alias("n"))
        .where("kind = 0").drop("kind")
    )


def dx_code_map(encounters: DataFrame, dx: DataFrame, dedupe_encounters: bool = False) -> DataFrame:
    """Per encounter, the earlier codes with how often each was seen, as a map in the order of the codes.

    An entry per different code: the cell is bounded by the code table, however often a patient's codes repeat.
    """
    counts = dx_code_counts(encounters, dx, dedupe_encounters)
    entries = F.array_sort(F.collect_list(F.struct("code", "n")))
    return counts.groupBy(*ENCOUNTER_KEY).agg(F.map_from_entries(entries).alias("codes"))


def dx_codes(encounters: DataFrame, dx: DataFrame, dedupe_encounters: bool = False) -> DataFrame:
    """Per encounter, the list of earlier codes, sorted, with repeats: ``dx_code_map`` written out, for those who ask for it."""
    return dx_code_map(encounters, dx, dedupe_encounters).select(*ENCOUNTER_KEY, F.flatten(F.transform(
        F.map_entries("codes"), lambda e: F.array_repeat(e["key"], e["value"].cast("int")))).alias("aggregated_codes"))


def comorbidity_features(encounters: DataFrame, dx: DataFrame, code_map: DataFrame,
                         max_groups: int = 1000) -> DataFrame:
    """0/1 per comorbidity, a mortality and a readmission score, from all codes before the encounter.

    A comorbidity is present from the day after its first code on, so all that is needed per patient is that first day
    per comorbidity; encounters then compare dates. Scores add the weights of the distinct (comorbidity, weights)
    entries present. The entries become columns and are read to the driver; more than ``max_groups`` is an error.
    Comorbidities of the table that nobody has get a column of zeros.
    """
    payload = ["comorbidity", "mortality_weight", "readmission_weight"]
    entries = code_map.select(*payload).distinct().orderBy(*payload).limit(max_groups + 1).collect()
    if len(entries) > max_groups:
        raise ValueError(f"more than {max_groups} distinct entries in the code table")
    keys = event_keys(dx)
    lookup = code_map.select("code", *payload).distinct()
    rows = daily(dx, "contact_date", {"_n": F.count(F.lit(1))}, by=["code"]).join(lookup, "code", "left")
    is_entry = lambda e: (F.col("comorbidity") == e[0]) & (F.col("mortality_weight") == e[1]) \
        & (F.col("readmission_weight") == e[2])
    first = rows.groupBy(*keys).agg(
        F.min("event_day").alias("_first"),
        *[F.min(F.when(is_entry(e), F.col("event_day"))).alias(f"_e{i}") for i, e in enumerate(entries)])
    seen = [F.coalesce((F.col(f"_e{i}") < F.col("appt_date")).cast("int"), F.lit(0)) for i in range(len(entries))]
    groups = sorted({e[0] for e in entries})
    flags = [F.greatest(*picks).alias(f"cmrbdt_{g}") if len(picks) > 1 else picks[0].alias(f"cmrbdt_{g}")
             for g in groups for picks in [[seen[i] for i, e in enumerate(entries) if e[0] == g]]]
    score = lambda pos: sum((seen[i] * F.lit(float(e[pos])) for i, e in enumerate(entries)), F.lit(0.0))
    return (
        encounter_days(encounters).join(first, keys).where(F.col("_first") < F.col("appt_date"))
        .select(*ENCOUNTER_KEY, *flags, score(1).alias("mrtlt_scr"), score(2).alias("rdmsn_scr"))
    )


def _died() -> Column:
    """Whether there is a death date; text that is no date is none."""
    return lenient_date("death_date").isNotNull()


def demographics(encounters: DataFrame, order: str = "csn") -> DataFrame:
    """Per patient and date: sex indicator, age, and whether the patient ever died (on any of their rows).

    The first non-missing sex and age of the date count, in the order of ``order``.
    """
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(order)))
    days = encounter_days(encounters, extra={
        "sex_indicator": first(sex_indicator("sex_c")), "age": first(age_years("birth_date", "appt_time")),
        "_dead": F.max(_died().cast("int"))})
    patient = Window.partitionBy("pat_id", "empi")
    return days.select(*ENCOUNTER_KEY, "sex_indicator", "age", F.max("_dead").over(patient).alias("dead"))


def mortality_flag(encounters: DataFrame) -> DataFrame:
    """Per patient: 1 when any row has a death date."""
    return encounters.dropna(subset=["pat_id", "empi"]).groupBy("pat_id", "empi") \
        .agg(F.max(_died().cast("int")).alias("dead"))


def asof_digest(encounters: DataFrame, events: DataFrame, event_time: str, value: str | None = None,
                dedupe_encounters: bool = False) -> DataFrame:
    """Per encounter, what lies before it: number of events, first and last day; count and sum of ``value``."""
    aggs = {"n": F.count(F.lit(1))}
    sums = {"n_events": F.col("n")}
    if value:
        aggs |= {"nv": F.count(value), "sv": F.sum(value)}
        sums |= {"n_values": F.col("nv"), "sum_value": F.col("sv")}
    return running_features(encounters, daily(events, event_time, aggs), sums=sums,
                            lows={"first_day": F.col("event_day")}, highs={"last_day": F.col("event_day")},
                            dedupe_encounters=dedupe_encounters)
