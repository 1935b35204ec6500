"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.scalars import quoted
from hindcast.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged. ``lower`` does the same, faster, where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(quoted(column)), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def free_name(wanted: str, taken: Sequence[str]) -> str:
    """``wanted``, with underscores before it until no column of that name (in any case) is taken."""
    names = {n.lower() for n in taken}
    while wanted.lower() in names:
        wanted = f"_{wanted}"
    return wanted


def id_text(column: str = "doc_id") -> Column:
    """The id as text, null as empty, as the splits by crc32 read it."""
    return F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))


def in_fold(column: str, folds: int, fold: int) -> Column:
    """crc32(id as text) mod ``folds`` = ``fold``; a null id counts as empty text (crc32 0)."""
    return F.crc32(id_text(column).cast("binary")) % folds == fold


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on a partition's batches, then the memory that it no longer uses given back to the system.

    Workers are used again by later stages, and what a C library keeps of freed memory would stay with them.
    """
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        with suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Batches of at most ``rows`` rows between Spark and Python for what runs inside, where rows hold texts or sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def numbered(docs: DataFrame, row: str = "row") -> DataFrame:
    """``docs`` with a number of its own for each row, written once.

    A number made on the fly depends on how a scan is cut into tasks, and so on the executors there are; two reads of one
    table may number it differently. The written number is data.
    """
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()))


def byte_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """[lo, hi) of rows side by side with texts of ``limit`` bytes together; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and total + size > limit:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(column):
        yield lo, len(column)


def total_of(df: DataFrame, value: Column) -> int:
    """One number on the driver: the sum of ``value``, 0 for no rows."""
    return int(df.agg(F.coalesce(F.sum(value), F.lit(0))).first()[0])
