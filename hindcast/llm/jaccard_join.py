"""All links between texts whose sets of word 5-grams have a Jaccard similarity of THRESHOLD or more, and their classes.

Texts with equal sets are one set. Sets that share a band of MinHash values meet in that band's bucket, each pair in the
first band they share. There pairs are compared SLICE values at a time and dropped as soon as the posterior probability
(uniform prior) that they reach the threshold is below TOLERANCE; the rest are verified on the sets themselves.

Pairs are never rows. A bucket is cut into tiles of at most two blocks of BLOCK sets, and a tile gives back a number of
links and one edge per set. Buckets with one set, which are nearly all, end after a count. With BANDS bands of ROWS values a
pair at the threshold shares none with probability 3e-6, at 0.9 with 1e-11.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalars import quoted
from hindcast.llm.common import byte_slices, free_name, numbered, released, small_batches, text_of
from hindcast.llm.wordhash import Words, digest, mix
from hindcast.session import materialize

THRESHOLD, SHINGLE = 0.8, 5
BANDS, ROWS, HASHES, SLICE = 24, 4, 128, 16
TOLERANCE = 1e-7
BLOCK = 1024
TILE = ["band", "key", "i", "j"]
_r = np.random.default_rng(11)
_A = _r.integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _r.integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Per number of compared values the fewest matches with P(similarity >= threshold) of ``tolerance`` or more: with a
    uniform prior that probability is P(Binomial(n + 1, threshold) <= matches)."""
    out = {}
    for n in range(SLICE, HASHES + 1, SLICE):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out[n] = m
                break
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of runs of SHINGLE lower-cased words; a shorter text's words are one run, an
    empty text has none."""
    w = Words(texts, lower=True)
    w.make_sure(np.arange(len(w.hash)))
    runs = w.runs(SHINGLE, 0)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a:b - SHINGLE + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for h in w.sure[0, a:b]:
                short = mix(short * np.uint64(3) + h)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) of 16 bits; an empty set has zeros."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    step = 0
    while step < len(full):
        # As many sets as stay in the processor's cache.
        upto, total = step, 0
        while upto < len(full) and (upto == step or total + len(sets[full[upto]]) <= 1 << 15):
            total += len(sets[full[upto]])
            upto += 1
        own = full[step:upto]
        flat = np.concatenate([sets[i] for i in own])
        head = np.cumsum([0] + [len(sets[i]) for i in own[:-1]])
        low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            least = np.minimum.reduceat(low * _A[k] + high * _B[k], head)
            out[own, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
        step = upto
    return out


def _set_key(s: np.ndarray) -> bytes:
    """128 bits of the set as a whole."""
    return digest(s.tobytes())


def describe(docs: DataFrame) -> DataFrame:
    """(row, doc_id, set_key, n, sig): a row per document, which holds ``row``, without its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                sets = shingle_sets(part.column(2).to_pylist())
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([_set_key(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["row", "doc_id", "set_key", "n", "sig"])

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"),
                       text_of().alias("text")).mapInArrow(released(run), "row long, doc_id long, set_key binary, n int, sig binary")


def _tiles(sets: DataFrame) -> DataFrame:
    """(band, key, i, j, block, m, row, n, sig): the sets of each tile of each bucket that holds two or more."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring(F.col("sig"), b * (2 * ROWS) + 1,
                                                                                     F.lit(2 * ROWS)))
    banded = sets.where("n > 0").select("row", F.posexplode(keys).alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialize(banded.join(shared, ["band", "key"]))
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("row"), blocks)
    others = F.sequence(F.lit(0).cast("long"), blocks - 1)
    spread = members.select("*", own.alias("block"), F.explode(others).alias("other")).select(
        "band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "row")
    return spread.join(sets.select("row", "n", "sig"), "row")


def _by_tile(df: DataFrame, work: Callable[[list[pd.DataFrame]], pd.DataFrame], schema: str, rows: int) -> DataFrame:
    """``work`` on lists of whole tiles, of about ``rows`` rows together; a tile is bounded by two blocks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for pdf in batches:
            while len(pdf):
                keys = pdf[TILE]
                if held:
                    last = held[-1][TILE].iloc[-1]
                    fresh = (keys != last).any(axis=1).to_numpy()
                else:
                    fresh = np.ones(len(pdf), bool)
                # Where the tile that is open ends; from there on the work may begin.
                cut = int(fresh.argmax()) if fresh.any() else len(pdf)
                if cut:
                    held.append(pdf.iloc[:cut])
                    count += cut
                    pdf = pdf.iloc[cut:]
                    continue
                if count >= rows:
                    yield work(held)
                    held, count = [], 0
                change = (keys.iloc[1:].to_numpy() != keys.iloc[:-1].to_numpy()).any(axis=1)
                ends = np.append(np.flatnonzero(change) + 1, len(pdf))
                take = int(ends[min(np.searchsorted(ends, max(rows - count, 1)), len(ends) - 1)])
                held.append(pdf.iloc[:take])
                count += take
                pdf = pdf.iloc[take:]
        if held:
            yield work(held)

    return df.repartition(*TILE).sortWithinPartitions(*TILE).mapInPandas(released(run), schema)


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    if not len(pdf):
        return np.zeros(1, np.int64)
    keys = pdf[TILE]
    change = (keys.iloc[1:].to_numpy() != keys.iloc[:-1].to_numpy()).any(axis=1)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(pdf)]])


def _pruner(need: dict[int, int]) -> Callable[[list[pd.DataFrame]], pd.DataFrame]:
    def prune(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts, ignore_index=True)
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), HASHES)
        bands = np.ascontiguousarray(sig[:, :BANDS * ROWS]).view(np.uint64)
        n, band, block, row = (pdf[c].to_numpy() for c in ("n", "band", "block", "row"))
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []

        def compare(a: np.ndarray, b: np.ndarray) -> None:
            sizes = np.minimum(n[a], n[b]) >= THRESHOLD * np.maximum(n[a], n[b]) - 1e-9
            a, b = a[sizes], b[sizes]
            first = (bands[a] == bands[b]).argmax(axis=1) == band[a]
            a, b = a[first], b[first]
            match = np.zeros(len(a), np.int64)
            for at in range(0, HASHES, SLICE):
                match += (sig[a, at:at + SLICE] == sig[b, at:at + SLICE]).sum(axis=1)
                on = match >= need[at + SLICE]
                a, b, match = a[on], b[on], match[on]
            left.append(a)
            right.append(b)

        wait_a: list[np.ndarray] = []
        wait_b: list[np.ndarray] = []
        waiting = 0
        at = _starts(pdf)
        for lo, hi in zip(at[:-1], at[1:]):
            if i[lo] == j[lo]:
                for x in range(lo, hi - 1) if hi - lo > 64 else [None]:
                    if x is None:
                        a, b = np.triu_indices(hi - lo, 1)
                        a, b = a + lo, b + lo
                    else:
                        b = np.arange(x + 1, hi)
                        a = np.full(len(b), x)
                    wait_a.append(a)
                    wait_b.append(b)
                    waiting += len(a)
                    if waiting > 50_000:
                        compare(np.concatenate(wait_a), np.concatenate(wait_b))
                        wait_a, wait_b, waiting = [], [], 0
            else:
                own = np.arange(lo, hi)
                one, two = own[block[lo:hi] == i[lo]], own[block[lo:hi] == j[lo]]
                for x in one:
                    compare(np.full(len(two), x), two)
        if waiting:
            compare(np.concatenate(wait_a), np.concatenate(wait_b))
        a, b = np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64), \
            np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64)
        used = np.unique(np.concatenate([a, b]))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        edges = np.searchsorted(a, [used, used + 1])
        out = pdf.iloc[used][[*TILE, "row"]].reset_index(drop=True)
        out["partners"] = [row[b[s:e]].astype("<i8").tobytes() for s, e in zip(*edges)]
        return out

    return prune


def _verify(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Per tile the verified links of each set, and the least set of those it hangs together with in the tile."""
    pdf = pd.concat(parts, ignore_index=True)
    rows_out, links_out, head_out = [], [], []
    at = _starts(pdf)
    for lo, hi in zip(at[:-1], at[1:]):
        row = pdf["row"].to_numpy()[lo:hi]
        order = np.argsort(row)
        sets = [np.frombuffer(b, "<u8") for b in pdf["set"].iloc[lo:hi]]
        pairs = [(x, np.frombuffer(p, "<i8")) for x, p in enumerate(pdf["partners"].iloc[lo:hi]) if len(p)]
        links = np.zeros(hi - lo, np.int64)
        root = np.arange(hi - lo)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        many = sum(len(p) for _, p in pairs) > 2000
        common = _common(sets) if many else None
        for x, partners in pairs:
            ys = order[np.searchsorted(row[order], partners)]
            for y in ys:
                both = common[x, y] if many else len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both >= THRESHOLD * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                    links[x] += 1
                    links[y] += 1
                    p, q = find(x), find(int(y))
                    if p != q:
                        small, large = (p, q) if row[p] < row[q] else (q, p)
                        root[large] = small
        for x in np.flatnonzero(links):
            rows_out.append(int(row[x]))
            links_out.append(int(links[x]))
            head_out.append(int(row[find(int(x))]))
    return pd.DataFrame({"row": np.array(rows_out, np.int64), "links": np.array(links_out, np.int64),
                         "head": np.array(head_out, np.int64)})


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share, by products of blocks of columns."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    member, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(member), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((len(sets), min(4096, len(member) - lo)), np.float32)
        x[who[a:b], column[a:b] - lo] = 1
        shared = x.sum(axis=0) > 1
        x = x[:, shared]
        out += x @ x.T
    return np.rint(out).astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(row, label): the least row of each connected component, from edges (row, head); rows without edge are left out.

    Alternating large and small stars; each round is a few shuffles of the edges, written, and rounds follow the log of the
    longest path. The driver sees a count and a checksum per round.
    """
    def sides(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(F.col("v"), F.col("u"))).distinct()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
        return both.join(least, "u")

    now = materialize(edges.select(F.col("row").alias("u"), F.col("head").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == last or not mark[0]:
            break
        last = mark
        large = sides(now).where("v > u AND v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")) \
            .unionAll(sides(now).where("u > least").select("u", F.col("least").alias("v"))).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("least"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v") \
            .unionAll(least.select("u", F.col("least").alias("v"))).distinct()
        now = materialize(small)
    return now.select(F.col("u").alias("row"), F.col("v").alias("label")) \
        .unionAll(now.select(F.col("v").alias("row"), F.col("v").alias("label")).distinct())


def link_documents(docs: DataFrame) -> DataFrame:
    """(row, doc_id, class_id, class_size, set_id, copies, n_links), a row per document.

    ``set_id`` is the least id of the documents with the same set, ``copies`` their number, ``n_links`` the number of other
    sets at THRESHOLD or more, ``class_id`` the least id of all documents that hang together by links and copies. A null
    text is empty; empty texts are copies of each other and have no links. A null id is passed over by "least" and stays null
    where there is no other. ``row`` is the row's number in the copy of the table that the work reads. Other columns are
    not looked at; an empty table gives no rows.
    """
    return _linked(numbered(docs.select("doc_id", "text")))


def _linked(docs: DataFrame) -> DataFrame:
    with small_batches(docs.sparkSession):
        base = materialize(describe(docs))
    sets = materialize(base.groupBy("set_key").agg(F.min("row").alias("row"), F.first("n").alias("n"),
                                                   F.first("sig").alias("sig"), F.min("doc_id").alias("set_id"),
                                                   F.count(F.lit(1)).alias("copies")))
    survivors = materialize(_by_tile(_tiles(sets), _pruner(needed()),
                                     "band int, key binary, i long, j long, row long, partners binary", 4096))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                found = [s.astype("<u8").tobytes() for s in shingle_sets(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["row", "set"])

    texts = docs.select("row", text_of().alias("text")) \
        .join(survivors.select("row").distinct(), "row", "left_semi").mapInArrow(released(hashes), "row long, set binary")
    with small_batches(docs.sparkSession):
        verified = materialize(_by_tile(survivors.join(texts, "row"), _verify, "row long, links long, head long", 512))
    labels = materialize(components(verified))
    links = verified.groupBy("row").agg(F.sum("links").alias("links"))
    classed = materialize(sets.join(labels, "row", "left").join(links, "row", "left").select(
        "set_key", "set_id", "copies", F.coalesce("label", "row").alias("label"),
        F.coalesce("links", F.lit(0)).alias("n_links")))
    classes = classed.groupBy("label").agg(F.min("set_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = classed.join(classes, "label")
    return base.select("row", "doc_id", "set_key").join(named, "set_key").select(
        "row", "doc_id", "class_id", "class_size", "set_id", "copies", "n_links", "label")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the largest id (the last of these in the table), with all columns."""
    row = free_name("row", docs.columns)
    rows = numbered(docs, row)
    linked = materialize(_linked(rows.select(F.col(row).alias("row"), "doc_id", "text"))
                         .where("class_size > 1").select("row", "doc_id", "label"))
    best = linked.groupBy("label").agg(F.max(F.struct("doc_id", "row")).alias("best"))
    dropped = linked.join(best, "label").where("row <> best.row").select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti") \
        .select(*[F.col(quoted(c)) for c in docs.columns])
