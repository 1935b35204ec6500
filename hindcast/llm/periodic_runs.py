"""Periodic runs of words in documents, and documents with their repetitions collapsed.

A run is a stretch of words that repeats with its smallest period at least twice, has LEAST words or more and cannot be
extended. Documents are read where they lie: no shuffle. Of those that an Arrow batch brings, documents of like length are
appended one after the other to one sequence, with a number of its own between them, and ``squares`` reports its runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import byte_slices, text_of
from hindcast.llm.squares import LEAST, Squares

SLICE = 1 << 18  # words appended at a time


def document_runs(documents: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Per document (start, length, period) of its runs."""
    found = [np.zeros((3, 0), np.int64)] * len(documents)
    number: dict[bytes, int] = {}
    classes: dict[int, list[int]] = {}
    for i, words in enumerate(documents):
        if len(words) >= least:
            classes.setdefault(len(words).bit_length(), []).append(i)
    for bits, members in classes.items():
        squares = Squares((1 << bits) - 1, least)
        sizes = np.array([len(documents[i]) for i in members])
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = np.empty(first[-1], np.int64)
        for n, i in enumerate(members):
            flat[first[n]:first[n + 1] - 1] = [number.setdefault(w, len(number)) for w in documents[i]]
        flat[first[1:] - 1] = -2 - np.arange(len(members))
        for at in range(0, len(flat), SLICE):
            squares.append(flat[at:at + SLICE])
        runs = squares.runs()
        bounds = np.searchsorted(runs[0], first)
        for n, i in enumerate(members):
            own = runs[:, bounds[n]:bounds[n + 1]]
            found[i] = own - np.array([[first[n]], [0], [0]])
    return found


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    if not runs.shape[1]:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[0] + runs[2], 1)
    np.add.at(change, runs[0] + runs[1], -1)
    return b" ".join(compress(words, np.cumsum(change)[:-1] == 0))


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), a row per document; ``runs`` by start, then period, each (start, length, period).

    Words are maximal runs of bytes other than space and tab to carriage return, compared as they are; the first has number
    0. ``collapsed`` has the words that stay, joined by one space: a word goes if a run holds it after its first period. A
    null text, like an empty one, has no words and no runs; rows with the same id or text are judged on their own; a null id
    stays null. Other columns are not looked at. An empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                documents = [text.split() for text in part.column(1).to_pylist()]
                runs = document_runs(documents, least)
                offsets = np.concatenate([[0], np.cumsum([r.shape[1] for r in runs])]).astype(np.int32)
                flat = np.concatenate(runs, axis=1)
                structs = pa.StructArray.from_arrays([pa.array(c) for c in flat], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(d) for d in documents], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), structs).cast(kind),
                    pa.array([_collapsed(d, r).decode("utf-8", "replace") for d, r in zip(documents, runs)], pa.string())],
                    names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by crc32 of its id repeats a stretch of its words up to its end.

    With h the checksum, g = floor(h / 10) and n words, from word a = g mod n on the p = 1 + floor((n - a) / (3 + g mod 8))
    words from a are repeated. Other texts are as they were.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    hit = docs.select("doc_id", text_of().alias("text"), h.alias("h"), F.floor(h / 10).alias("g")) \
        .withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    n = F.size("words")
    hit = hit.withColumn("n", n.cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))) \
        .withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))").cast("int"))
    tail = F.expr("slice(words, CAST(a AS INT) + 1, p)")
    copies = F.expr("CAST(ceil((n - a) / p) AS INT)")
    edited = F.concat(F.expr("slice(words, 1, CAST(a AS INT))"),
                      F.slice(F.flatten(F.array_repeat(tail, copies)), F.lit(1), (F.col("n") - F.col("a")).cast("int")))
    return hit.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", edited)).otherwise(F.col("text")).alias("text"))
