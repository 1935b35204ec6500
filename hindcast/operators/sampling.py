"""Cohort sampling and splitting, reproducible by seed and key."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions.draws import MovedCounts, REPLICATE_STEP, key_hash, mix32, poisson, poisson_cuts, uniform
from hindcast.functions.scalars import quoted
from hindcast.operators.prefix import random_rank
from hindcast.session import materialize, shuffle_width, spread


def sample_one(df: DataFrame, seed: int, patient: str = "empi", key: str = "csn") -> DataFrame:
    """One random row per patient: the row with the least draw.

    An aggregate, not a ranked window: it combines on the map side, so a patient with very many rows is no burden.
    """
    row = F.struct(*[F.col(quoted(c)) for c in df.columns])
    best = F.min(F.struct(uniform(seed, key).alias("u"), F.col(key).alias("k"), row.alias("row")))
    return df.groupBy(patient).agg(best.alias("b")).select("b.row.*")


def group_by_draw(u: Column, prop_train: float) -> Column:
    return F.when(u < prop_train, F.lit("train")).otherwise(F.lit("test"))


def split_patients(df: DataFrame, seed: int = 123456, prop_train: float = 0.7, patient: str = "empi") -> DataFrame:
    """Add ``group``: all rows of a patient go to the same side. No shuffle; the share is met on average."""
    return df.withColumn("group", group_by_draw(uniform(seed, patient), prop_train))


def split_patients_exact(df: DataFrame, seed: int = 123456, prop_train: float = 0.7,
                         patient: str = "empi") -> DataFrame:
    """Add ``group`` with exactly ``int(patients * prop_train)`` patients in train.

    Only patient ids are ranked. What comes out is the last draw that still belongs to train; rows compare their own
    patient's draw with it, so the table itself is neither joined nor shuffled.
    """
    patients = df.select(patient).where(F.col(patient).isNotNull()).distinct()
    size = patients.agg(F.floor(F.count(F.lit(1)) * F.lit(prop_train)).alias("n")).scalar()
    draw = F.struct(uniform(seed, patient).alias("u"), F.col(patient).alias("k"))
    last = random_rank(patients, seed, patient).where(F.col("rank") == size).select(draw.alias("d")).scalar()
    in_train = F.coalesce(draw <= last, F.lit(False))
    return df.withColumn("group", F.when(in_train, F.lit("train")).otherwise(F.lit("test")))


def split_rows(df: DataFrame, seed: int = 42, test_size: float = 0.3, key: str = "csn") -> DataFrame:
    """Add ``group`` row by row."""
    return df.withColumn("group", F.when(uniform(seed, key) < test_size, F.lit("test")).otherwise(F.lit("train")))


def rows_of(df: DataFrame, patients: DataFrame, patient: str = "empi") -> DataFrame:
    """The rows whose patient is in ``patients``."""
    return df.join(patients.select(patient).distinct(), patient, "left_semi")


def cohort_ids(df: DataFrame, columns: Sequence[str] = ("csn", "pat_id")) -> DataFrame:
    """Train ids, then test ids, each tagged with its group."""
    side = lambda g: df.where(F.col("group") == g).select(*columns, F.lit(g).alias("group"))
    return side("train").unionByName(side("test"))


def label_rates(df: DataFrame, label: str = "label", by: str = "group") -> DataFrame:
    return df.groupBy(by).agg(F.avg(label).alias("rate"), F.sum(F.col(label).cast("bigint")).alias("positives"),
                              F.count(F.lit(1)).alias("n"))


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label", key: str = "csn",
                     out: str = "fold") -> DataFrame:
    """Add ``out``, 0 to k-1: within each label the folds differ by at most one row."""
    ranked = random_rank(df, seed, key, "_rank", [label])
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def _spread_keys(df: DataFrame, seed: int, key: str) -> DataFrame:
    """(key, _slot): every key with its hash, dealt out evenly, for work that multiplies per key."""
    return key_hash(spread(df.select(key), key), seed, key, "_slot")


@dataclass(frozen=True)
class Resample:
    """n-of-n draws of many replicates: a count that each row draws by itself, and a few draws that are dealt out.

    Independent Poisson counts, given their sum t, are t draws of n rows with replacement. So each row draws a Poisson count
    from its own key, at a rate a little below 1; what a replicate then lacks to n, about ``SHORT`` * sqrt(n) draws, is
    drawn row by row and added. Together they are n draws of n rows, and only the added ones travel. A replicate whose counts
    already exceed n, which happens about once in a billion, takes the next stream of counts.
    """

    n: int
    cuts: tuple[int, ...]
    streams: np.ndarray  # per replicate, the number that its rows' hashes are moved by
    missing: np.ndarray  # per replicate, the draws to add


SHORT = 6
CELLS = 1 << 17  # rows times replicates drawn at a time


def moves(streams: np.ndarray) -> np.ndarray:
    """What a row's hash moves by in each stream."""
    return (streams.astype(np.uint64) * np.uint64(REPLICATE_STEP)).astype(np.uint32)


def row_counts(slots: np.ndarray, streams: np.ndarray, cuts: Sequence[int]) -> np.ndarray:
    """(rows, streams): each row's own count in each stream."""
    return MovedCounts(cuts)(slots.astype(np.uint32), moves(streams))


def column_sums(counts: np.ndarray) -> np.ndarray:
    """Sums over the rows: bytes of 16 counts of at most 13 each, then their sums."""
    whole = len(counts) // 16 * 16
    by_16 = np.add.reduce(counts[:whole].reshape(-1, 16, counts.shape[1]), axis=1, dtype=np.uint8)
    return by_16.sum(axis=0, dtype=np.int64) + counts[whole:].sum(axis=0, dtype=np.int64)


def _totals(streams: np.ndarray, cuts: Sequence[int]) -> Callable:
    """From batches of _slot: one row per task, the counts of its rows added up per stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, width, counts, moved = np.zeros(len(streams), np.int64), 256, MovedCounts(cuts), moves(streams)
        for batch in batches:
            slots = batch.column("_slot").to_numpy().astype(np.uint32)
            for first in range(0, len(streams), width):
                for at in range(0, len(slots), CELLS // width):
                    total[first:first + width] += column_sums(counts(slots[at:at + CELLS // width], moved[first:first + width]))
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["totals"])

    return run


def plan_resample(df: DataFrame, replicates: int, seed: int = 12345, key: str = "csn") -> Resample:
    """How to draw as many rows as ``df`` has, ``replicates`` times. The driver holds two numbers per replicate."""
    slots = _spread_keys(df, seed, key).select("_slot")
    n = df.count()
    cuts = tuple(poisson_cuts(max(0.0, 1 - SHORT / math.sqrt(n)) if n else 0.0))
    streams, missing = np.arange(replicates, dtype=np.int64), np.zeros(replicates, np.int64)
    todo = np.arange(replicates)
    while len(todo):
        sums = slots.mapInArrow(_totals(streams[todo], cuts), "totals array<bigint>") \
            .select(F.posexplode("totals").alias("i", "total")).groupBy("i").agg(F.sum("total").alias("total")).collect()
        total = np.zeros(len(todo), np.int64)
        for r in sums:
            total[r.i] = r.total
        missing[todo] = n - total
        todo = todo[total > n]
        streams[todo] += replicates
    return Resample(n, cuts, streams, missing)


def added_draws(spark: SparkSession, plan: Resample, seed: int) -> DataFrame:
    """(ordinal, extra): for the rows drawn in addition, by number, the replicates that drew them, with repeats."""
    wanted = spark.createDataFrame(list(zip(range(len(plan.missing)), plan.missing.tolist())), "b int, missing bigint")
    picks = wanted.repartition(shuffle_width(spark), "b").where("missing > 0") \
        .select("b", F.explode(F.sequence(F.lit(1).cast("bigint"), "missing")).alias("pick"))
    ordinal = F.floor(uniform(seed, "b", "pick") * plan.n).alias("ordinal")
    return picks.select(ordinal, "b").groupBy("ordinal").agg(F.collect_list("b").alias("extra"))


def row_ordinals(df: DataFrame, seed: int = 12345, key: str = "csn") -> DataFrame:
    """(key, ordinal): the rows numbered from 0."""
    return random_rank(df.select(key), seed, key, "ordinal").withColumn("ordinal", F.col("ordinal") - 1)


def with_added(rows: DataFrame, keys: DataFrame, plan: Resample, seed: int, key: str) -> DataFrame:
    """``rows`` with ``_extra``, the replicates that drew the row's key in addition.

    Both joins are merges by hint. The draws come from a table of one small row per replicate, and Spark, which goes by that
    table's size, would send all of them through the driver.
    """
    extra = row_ordinals(keys, seed, key).join(added_draws(rows.sparkSession, plan, seed).hint("merge"), "ordinal") \
        .select(key, F.col("extra").alias("_extra"))
    return rows.join(extra.hint("merge"), key, "left")


def bootstrap_draws(df: DataFrame, replicates: int, seed: int = 12345, key: str = "csn") -> DataFrame:
    """n-of-n resampling with replacement: (b, key, weight), weight being how often replicate b drew the row. Rows that a
    replicate did not draw are left out. What is shuffled are the rows and about SHORT * sqrt(n) draws per replicate."""
    plan = plan_resample(df, replicates, seed, key)
    stream = F.col("b").cast("bigint")
    for b in np.flatnonzero(plan.streams != np.arange(replicates)).tolist():
        stream = F.when(F.col("b") == b, F.lit(int(plan.streams[b]))).otherwise(stream)
    rows = with_added(_spread_keys(df, seed, key), df.select(key), plan, seed, key) \
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = mix32(rows, F.col("_slot") + stream * F.lit(REPLICATE_STEP), "_h1")
    b = F.col("b")
    extra = F.when(F.col("_extra").isNull(), F.lit(0)).otherwise(F.size(F.filter("_extra", lambda x: x == b)))
    return rows.select("b", key, (poisson(F.col("_h1"), plan.cuts) + extra).cast("bigint").alias("weight")).where("weight > 0")


def poisson_draws(df: DataFrame, replicates: int, seed: int = 12345, key: str = "csn") -> DataFrame:
    """The form without any shuffle: each row gets a Poisson(1) weight per replicate, from its own key; zero weights are
    left out. Sizes vary around n instead of being n, by a share of about 1/sqrt(n).
    """
    rows = _spread_keys(df, seed, key) \
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = mix32(rows, F.col("_slot") + F.col("b") * F.lit(REPLICATE_STEP), "_h1")
    return rows.select("b", key, poisson(F.col("_h1")).cast("bigint").alias("weight")).where("weight > 0")


RANGES = 4096  # of the draws of all rows; each is cut into as many again


def _in_total(counts: np.ndarray) -> Callable:
    """From batches of (draw, ordinal): the range that holds the ordinal, and its rank there."""
    upto = np.cumsum(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordinal = batch.column(1).to_numpy()
            place = np.searchsorted(upto, ordinal, "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), pa.array(ordinal - (upto - counts)[place])],
                                             names=["draw", "range", "rank"])

    return run


def _in_range(draws: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Of a range: the slot that holds each rank, and the row's place in it."""
    counts = counts.sort_values("slot")
    upto = np.cumsum(counts["n"].to_numpy())
    place = np.searchsorted(upto, draws["rank"].to_numpy(), "right")
    before = (upto - counts["n"].to_numpy())[place] if len(place) else place
    return pd.DataFrame({"draw": draws["draw"].to_numpy(), "slot": counts["slot"].to_numpy()[place],
                         "place": draws["rank"].to_numpy() - before + 1})


def rows_by_rank(df: DataFrame, ordinals: DataFrame, seed: int, key: str) -> DataFrame:
    """(draw, and the columns of ``df``): for each (draw, ordinal) the row with that number, from 0, in an order drawn by key.

    Rows are counted per slot of their random number, 2^24 of them; ranges of slots say where a number lies, first the range
    (RANGES counts, on the driver) and then the slot in it. Only rows in slots that hold a wanted number are numbered, so
    the table is neither sorted nor shuffled as a whole.
    """
    slot = F.least(F.floor(uniform(seed, key) * (RANGES * RANGES)), F.lit(RANGES * RANGES - 1)).cast("bigint")
    counts = materialize(df.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
                         .withColumn("range", F.floor(F.col("slot") / RANGES)))
    total = np.zeros(RANGES, np.int64)
    for r in counts.groupBy("range").agg(F.sum("n").alias("n")).collect():
        total[r["range"]] = r.n
    if not total.sum():
        return ordinals.select("draw").join(df, F.lit(False), "inner")
    placed = ordinals.select(F.col("draw").cast("bigint"), F.col("ordinal").cast("bigint")) \
        .mapInArrow(_in_total(total), "draw bigint, range bigint, rank bigint")
    wanted = materialize(placed.groupBy("range").cogroup(counts.groupBy("range"))
                         .applyInPandas(_in_range, "draw bigint, slot bigint, place bigint"))
    names = [F.col(quoted(c)) for c in df.columns]
    wanted = wanted.withColumnsRenamed({c: f"_wanted_{c}" for c in ("draw", "slot", "place")})
    some = df.withColumn("_slot", slot).join(wanted.select(F.col("_wanted_slot").alias("_slot")).distinct(), "_slot", "left_semi")
    numbered = some.withColumn("_place", F.row_number().over(Window.partitionBy("_slot").orderBy(uniform(seed, key), key)))
    return wanted.join(numbered, (F.col("_wanted_slot") == F.col("_slot")) & (F.col("_wanted_place") == F.col("_place"))) \
        .select(F.col("_wanted_draw").alias("draw"), *names)


def background_sample(df: DataFrame, draws: DataFrame, seed: int, key: str, draw: str = "draw") -> DataFrame:
    """One uniformly drawn row of ``df`` per row of ``draws``, with replacement."""
    n = df.count()
    ordinals = draws.select(F.col(draw).alias("draw"), F.floor(uniform(seed, draw) * n).alias("ordinal"))
    picked = rows_by_rank(df, ordinals, seed, key)
    return draws.join(picked.withColumnRenamed("draw", draw), draw)
