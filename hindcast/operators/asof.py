"""Events before each encounter.

An event counts for an encounter of the same patient when its calendar date is strictly before the encounter's date;
events of the same day never count. Two forms:

* ``asof_join`` writes one row per (encounter, earlier event). Its size is the product within a patient, so features
  are not built on it; it is for looking at the pairs themselves.
* ``running_features`` gives the same aggregates without the pairs. Events are first reduced to one row per patient,
  calendar day (and category), encounters to one row per patient and day. Then one running window per patient reads
  days in order. The reduction combines on the map side, so a patient who owns a third of all events costs no more
  than one row per day and category: the window's group is bounded by the calendar, not by the number of events.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import quoted

ENCOUNTER_KEY = ("pat_id", "empi", "appt_date")


def event_keys(events: DataFrame) -> list[str]:
    """The patient key: ``pat_id`` and, where the event table has it, ``empi``."""
    return ["pat_id", "empi"] if "empi" in events.columns else ["pat_id"]


def asof_join(encounters: DataFrame, events: DataFrame, event_time: str, appt_time: str = "appt_time",
              dedupe_encounters: bool = False, hot_rows: int = 1_000_000) -> DataFrame:
    """Encounter key and event columns for every earlier event.

    Patients with more than ``hot_rows`` events are split: their events are dealt over slices by a hash of the row,
    their encounters are repeated once per slice, so no task holds all the events of one patient.
    """
    keys = event_keys(events)
    left = encounters.select("pat_id", "empi", F.to_date(appt_time).alias("appt_date")).where("appt_date is not null")
    if dedupe_encounters:
        left = left.distinct()
    right = events.where(F.to_date(event_time).isNotNull())
    width = F.ceil(F.col("n") / F.lit(float(hot_rows))).cast("int")
    hot = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows) \
        .select(*keys, width.alias("_slices"))
    row_hash = F.xxhash64(*[F.col(quoted(c)) for c in right.columns])
    slices = F.coalesce("_slices", F.lit(1))
    right = right.join(hot, keys, "left").withColumn("_slice", F.pmod(row_hash, slices).cast("int")).drop("_slices")
    left = left.join(hot, keys, "left") \
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - F.lit(1)))).drop("_slices")
    joined = left.join(right, [*keys, "_slice"]).where(F.to_date(event_time) < F.col("appt_date"))
    rest = [F.col(quoted(c)) for c in events.columns if c not in keys]
    return joined.select(*ENCOUNTER_KEY, *rest)


def encounter_days(encounters: DataFrame, appt_time: str = "appt_time",
                   extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per patient and encounter date, with the number of encounters on it and ``extra`` aggregates."""
    cols = {k: v.alias(k) for k, v in (extra or {}).items()}
    return (
        encounters.withColumn("appt_date", F.to_date(appt_time)).dropna(subset=list(ENCOUNTER_KEY))
        .groupBy(*ENCOUNTER_KEY).agg(F.count(F.lit(1)).alias("n_enc"), *cols.values())
    )


def daily(events: DataFrame, event_time: str, aggs: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Events reduced to one row per patient, calendar day and category."""
    keys = event_keys(events)
    return (
        events.withColumn("event_day", F.to_date(event_time)).dropna(subset=["event_day", *keys])
        .groupBy(*keys, "event_day", *by).agg(*[c.alias(k) for k, c in aggs.items()])
    )


def running_features(encounters: DataFrame, days: DataFrame, sums: Mapping[str, Column] | None = None,
                     lasts: Mapping[str, Column] | None = None, lows: Mapping[str, Column] | None = None,
                     highs: Mapping[str, Column] | None = None, count: Column | None = None,
                     appt_time: str = "appt_time", dedupe_encounters: bool = False) -> DataFrame:
    """Per encounter date, aggregates over the patient's earlier days.

    ``sums`` / ``lasts`` / ``lows`` / ``highs`` map output names to expressions over a row of ``days``. Sums count an
    event once per encounter of the date, so a patient seen twice on a day has doubled sums, unless
    ``dedupe_encounters``. Encounters without an earlier row are left out.
    """
    keys = event_keys(days)
    left = encounter_days(encounters, appt_time)
    order = Window.partitionBy(*keys).orderBy("_day", "_kind") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Encounters sort before the events of their own day.
    parts = {**{k: (F.sum, v) for k, v in (sums or {}).items()}, **{k: (F.min, v) for k, v in (lows or {}).items()},
             **{k: (F.max, v) for k, v in (highs or {}).items()}}
    lasts = lasts or {}
    inputs = {**{k: v for k, (_, v) in parts.items()}, **lasts}
    slot = {k: f"_v{i}" for i, k in enumerate(inputs)}
    events = days.select(*keys, F.col("event_day").alias("_day"), F.lit(1).alias("_kind"),
                         (count if count is not None else F.lit(1)).alias("_seen"),
                         *[c.alias(slot[k]) for k, c in inputs.items()])
    encs = left.select(*keys, F.col("appt_date").alias("_day"), F.lit(0).alias("_kind"), F.lit(0).alias("_seen"),
                       F.col("n_enc").alias("_n"), *([] if "empi" in keys else ["empi"]))
    rows = encs.unionByName(events, allowMissingColumns=True)
    times = F.lit(1) if dedupe_encounters else F.col("_n")
    out = {k: (agg(slot[k]).over(order) * times if agg is F.sum else agg(slot[k]).over(order))
           for k, (agg, _) in parts.items()}
    out |= {k: F.last(slot[k], ignorenulls=True).over(order) for k in lasts}
    return (
        rows.select("pat_id", "empi", F.col("_day").alias("appt_date"), "_kind",
                    F.sum("_seen").over(order).alias("_seen"), *[out[k].alias(k) for k in inputs])
        .where((F.col("_kind") == 0) & (F.col("_seen") > 0)).drop("_kind", "_seen")
    )
