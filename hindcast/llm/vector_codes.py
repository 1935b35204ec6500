"""Vectors as short codes: each part of a vector by the number of its nearest codebook entry.

Codebooks are refined by rounds of assigning and averaging over all vectors. From the second assignment on, bounds save most
distances (norm-of-sum bounds): per part and group of entries a vector keeps a lower bound on its distance to the group and
the round in which that bound was exact. The codebooks of all rounds are kept, so a bound is lowered by the largest
net displacement of the group's entries between its stamped round and now, which is never more than the sum of their moves
round by round. Only groups whose bound does not exceed the distance to the vector's own entry are scanned again, exactly,
and get a new bound and stamp.

Distances between integers are integers, computed exactly; bounds are rounded down, so codes are those of a full search.
Vectors stay in the tasks that read them, and each round writes them with their state once. A task adds its sums as one
row; the codebooks are all that reaches the driver, and their size is fixed by the parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalars import quoted
from hindcast.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
GROUPS = 8  # groups of entries that share a bound
LIMIT = 1 << 25  # integers beyond are set to it: sums of squares fit 64 bits up to 2,048 components
BLOCK = 4096  # vectors worked on at a time
SLACK = 1e-9  # relative; far above the rounding of distances, so that a bound never excludes a nearest entry


def usable(vector: Column, parts: int = PARTS) -> Column:
    """Whether a vector is there, has components in a multiple of ``parts``, and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & (F.size(vector) % parts == 0) & F.coalesce(finite, F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int32)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, entries)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        d = x.astype(np.int64) - entry
        out[:, j] = (d * d).sum(axis=1)
    return out


@dataclass
class Codebooks:
    """``history[t]``: (parts, entries, width) after t rounds. ``scans``: exact distances computed in each assignment."""

    history: list[np.ndarray]
    scans: list[int] = field(default_factory=list)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.history[-1].ravel().tolist())).encode()).hexdigest()

    def displacements(self, net: bool = True) -> np.ndarray:
        """(round, part, group): how far the group's entries have moved from each earlier round to the last, at most.

        ``net=False`` adds up the moves round by round instead, which is what bounds without a history must do.
        """
        now, groups = len(self.history) - 1, min(GROUPS, self.history[0].shape[1])
        out = np.zeros((max(now, 1), self.history[0].shape[0], groups))
        for t in range(now):
            steps = [(t, now)] if net else [(s, s + 1) for s in range(t, now)]
            moved = sum(np.sqrt(((self.history[b] - self.history[a]).astype(np.float64) ** 2).sum(axis=2)) for a, b in steps)
            for g in range(groups):
                out[t, :, g] = moved[:, g::groups].max(axis=1)
        return out


def assign(x: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, books: Codebooks,
           moved: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, int]:
    """The nearest entry of each part of each vector, ties to the lower index.

    ``state`` holds codes (n, parts), lower bounds and stamps (n, parts, groups) of the assignment before; bounds leave out
    the vector's own entry. Gives the new state, the squared distances summed over parts and the number of distances computed.
    """
    book, now = books.history[-1], len(books.history) - 1
    parts, k, width = book.shape
    groups = moved.shape[2]
    codes = np.zeros((len(x), parts), np.uint8) if state is None else state[0].copy()
    lower = np.zeros((len(x), parts, groups), np.float32) if state is None else state[1].copy()
    stamp = np.zeros((len(x), parts, groups), np.uint8) if state is None else state[2].copy()
    error, scans = np.zeros(len(x), np.int64), 0
    for p in range(parts):
        own = x[:, p * width:(p + 1) * width]
        old = codes[:, p].astype(np.int64)
        d = own.astype(np.int64) - book[p][old]
        before = (d * d).sum(axis=1)  # to the entry of the last assignment
        scans += len(x)
        best, at = before.copy(), old.copy()
        upper = np.sqrt(before.astype(np.float64))
        if state is None:
            bound = np.full((len(x), groups), -1.0)
        else:
            drift = moved[stamp[:, p], p, np.arange(groups)]
            bound = lower[:, p] - drift
            bound -= SLACK * (1 + drift + upper[:, None])
        seen = np.full((len(x), groups), -1, np.int64)  # smallest distance in a scanned group, its own entry left out
        scanned = bound <= upper[:, None]
        nearest = {}
        for g in range(groups):
            rows = np.flatnonzero(scanned[:, g])
            if not len(rows):
                continue
            members = np.arange(g, k, groups)
            squares = _squares(own[rows], book[p][members])
            scans += squares.size
            first = squares.argmin(axis=1)
            least, where = squares[np.arange(len(rows)), first], members[first]
            better = (least < best[rows]) | ((least == best[rows]) & (where < at[rows]))
            best[rows[better]], at[rows[better]] = least[better], where[better]
            nearest[g] = (rows, members, squares)
        for g, (rows, members, squares) in nearest.items():
            held = members[None, :] == at[rows][:, None]
            squares[held] = np.iinfo(np.int64).max
            lower[rows, p, g] = np.sqrt(squares.min(axis=1).astype(np.float64)) * (1 - 1e-6)
            stamp[rows, p, g] = now
        # A vector that left its entry: the bound of that entry's group, if not scanned, now has to hold for it too.
        left = np.flatnonzero(at != old)
        g = old[left] % groups
        left, g = left[~scanned[left, g]], g[~scanned[left, g]]
        if len(left):
            lower[left, p, g] = np.maximum(0, np.minimum(bound[left, g], upper[left])) * (1 - 1e-6)
            stamp[left, p, g] = now
        codes[:, p] = at
        error += best
    return (codes, lower, stamp), error, scans


def _sums(x: np.ndarray, codes: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """(parts, entries, width + 1): sums of the parts that each entry got, and their number."""
    parts, k, width = shape
    out = np.zeros((parts, k, width + 1), np.int64)
    for p in range(parts):
        for c in range(width):
            out[p, :, c] = np.rint(np.bincount(codes[:, p], weights=x[:, p * width + c], minlength=k)).astype(np.int64)
        out[p, :, width] = np.bincount(codes[:, p], minlength=k)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def _blobs(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _unblob(column: pa.Array, dtype: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _step(table: DataFrame, books: Codebooks, first: bool, last: bool) -> DataFrame:
    """One assignment over all vectors: their new state and a row of sums per task, or, at last, codes and errors."""
    parts, k, width = books.history[0].shape
    groups, moved = min(GROUPS, k), books.displacements()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scans, names = np.zeros((parts, k, width + 1), np.int64), 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                names = batch.schema
                if first:
                    x, state = _matrix(batch.column(2), parts * width), None
                else:
                    x = _unblob(batch.column(2), np.int32, (parts * width,))
                    state = tuple(_unblob(batch.column(3 + i), t, s) for i, (t, s) in enumerate(
                        ((np.uint8, (parts,)), (np.float32, (parts, groups)), (np.uint8, (parts, groups)))))
                state, error, n = assign(x, state, books, moved)
                if last:
                    codes = [row.tobytes().hex() for row in state[0]]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()),
                                                      pa.array(error)], names=["id", "label", "code", "error"])
                    continue
                scans += n
                total += _sums(x, state[0], (parts, k, width))
                none = pa.nulls(len(x), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(_blobs, (x, *state)), none],
                                                 names=["id", "label", "x", "code", "lower", "stamp", "sums"])
        if names is not None and not last:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, names.field(0).type), pa.nulls(1, names.field(1).type), *[pa.nulls(1, pa.binary())] * 4,
                 pa.array([[*total.ravel().tolist(), scans]], pa.list_(pa.int64()))],
                names=["id", "label", "x", "code", "lower", "stamp", "sums"])

    kinds = f"id {table.schema['id'].dataType.simpleString()}, label {table.schema['label'].dataType.simpleString()}"
    columns = ["id", "label", "x"] + ([] if first else ["code", "lower", "stamp"])
    return table.select(columns).mapInArrow(run, f"{kinds}, code string, error long" if last else
                                            f"{kinds}, x binary, code binary, lower binary, stamp binary, sums array<bigint>")


def _refined(table: DataFrame, books: Codebooks) -> Codebooks:
    """The next codebooks: the floor of each entry's mean part; entries without parts stay."""
    book = books.history[-1]
    rows = table.where("sums IS NOT NULL").select(F.posexplode("sums").alias("pos", "value")) \
        .groupBy("pos").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(book.shape[0] * book.shape[1] * (book.shape[2] + 1) + 1, np.int64)
    for r in rows:
        flat[r.pos] = r.value
    sums = flat[:-1].reshape(*book.shape[:2], -1)
    count = sums[:, :, -1:]
    mean = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), book)
    return Codebooks([*books.history, mean], [*books.scans, int(flat[-1])])


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error), a row per usable vector, and the codebooks.

    A vector that is null, empty, holds null or non-finite components or does not divide into ``parts`` is dropped; so is one
    that is not as long as the usable vector with the least id. Components become floor(SCALE * x), at most LIMIT from
    zero. The codebooks start as the vectors of the ``entries`` least ids (rows with one id by their components, null ids
    after all others; fewer where there are fewer rows). ``code`` has two hex digits per part, ``error`` is the squared distance
    summed over parts. Repeated rows count each; other columns are not looked at. Without usable vectors there are no
    rows and no codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte per part: entries must be 1 to 256")
    table = vectors.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(label_column)).alias("label"),
                           F.col(quoted(vector_column)).alias("x")).where(usable(F.col("x"), parts))
    order = [F.col("id").asc_nulls_last(), F.col("x")]
    head = table.orderBy(*order).limit(1).collect()
    if not head:
        kinds = [f"{c} {table.schema[c].dataType.simpleString()}" for c in ("id", "label")]
        return vectors.sparkSession.createDataFrame([], ", ".join(kinds) + ", code string, error long"), None
    table = table.where(F.size("x") == len(head[0].x))
    start = integers(np.array([r.x for r in table.orderBy(*order).limit(entries).collect()], np.float64))
    books = Codebooks([start.reshape(len(start), parts, -1).swapaxes(0, 1).astype(np.int64)])
    for step in range(rounds):
        table = materialize(_step(table if step == 0 else table.where("sums IS NULL"), books, step == 0, False))
        books = _refined(table, books)
    return _step(table.where("sums IS NULL"), books, rounds == 0, True), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors summed over equal labels, nulls together."""
    coded = materialize(coded)
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")
