"""A byte-level convolutional classifier of whole texts, in numpy.

A text is cut into overlapping chunks of CHUNK bytes, a new one every HALF bytes, up to its end. Learned filters over
eight bytes run through each chunk; their highest and mean answers make the chunk's hidden units, each unit's highest
value over all chunks is the text's, and a logistic unit combines these into one probability. Long texts go through in
pieces, so memory does not follow a text's length.

The fit runs in one task on a bounded sample: at most ``SAMPLE`` labelled rows of each class, chosen by a hash of their
id. Its result is a few thousand numbers. Scores are made where the texts are read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.functions.scalars import quoted
from hindcast.llm.common import byte_slices, free_name, in_fold, released, text_of

HALF, STEP, EMBED, FILTERS, HIDDEN = 128, 4, 4, 24, 12
CHUNK = 2 * HALF
PIECE = 256  # chunks
BLOCK_BYTES = 1 << 19
SAMPLE = 2000
STEPS, BATCH, RATE = 1200, 48, 0.004


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
    wide = STEP * EMBED
    return {"embed": draw(256, EMBED, scale=0.7), "near": draw(wide, FILTERS, scale=0.25),
            "far": draw(wide, FILTERS, scale=0.25), "bias": np.zeros(FILTERS, np.float32),
            "mid": draw(2 * FILTERS, HIDDEN, scale=0.2), "mid_bias": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32)}


def _pieces(blob: bytes) -> Iterator[np.ndarray]:
    """Halves of a text, chunk c being halves c and c + 1; each piece has one half more, which its filters look into.
    What lies behind the end is zero."""
    chunks = max(1, -(-len(blob) // HALF) - 1)
    for at in range(0, chunks, PIECE):
        n = min(PIECE, chunks - at)
        part = blob[at * HALF:(at + n + 2) * HALF]
        yield np.frombuffer(part.ljust((n + 2) * HALF, b"\0"), np.uint8)


def _filtered(model: dict, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes embedded in rows of STEP, filters' answers there)."""
    x = model["embed"][raw].reshape(-1, STEP * EMBED)
    z = x @ model["near"]
    z[:-1] += x[1:] @ model["far"]
    z += model["bias"]
    np.maximum(z, 0, out=z)
    return x, z


def _hidden(model: dict, raw: np.ndarray) -> np.ndarray:
    """The hidden units of the chunk that starts at each half but the last."""
    _, z = _filtered(model, raw)
    z = z.reshape(-1, HALF // STEP, FILTERS)
    top, mean = z.max(axis=1), z.mean(axis=1)
    pooled = np.concatenate([np.maximum(top[:-1], top[1:]), (mean[:-1] + mean[1:]) / 2], axis=1)
    return np.tanh(pooled @ model["mid"] + model["mid_bias"])


def _pooled(model: dict, blobs: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the highest value of each hidden unit, and the number of the chunk where it is."""
    best = np.full((len(blobs), HIDDEN), -2, np.float32)
    where = np.zeros((len(blobs), HIDDEN), np.int64)
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        h = _hidden(model, np.concatenate([p for _, _, p in held]))
        at = 0
        for doc, first, part in held:
            n = len(part) // HALF
            own = h[at:at + n - 2]
            at += n
            most = own.argmax(axis=0)
            value = own[most, np.arange(HIDDEN)]
            better = value > best[doc]
            best[doc][better] = value[better]
            where[doc][better] = first + most[better]

    for doc, blob in enumerate(blobs):
        for number, part in enumerate(_pieces(blob)):
            held.append((doc, number * PIECE, part))
            size += len(part)
            if size >= BLOCK_BYTES:
                flush()
                held, size = [], 0
    flush()
    return best, where


def probabilities(model: dict, blobs: Sequence[bytes]) -> np.ndarray:
    best, _ = _pooled(model, blobs)
    return 1 / (1 + np.exp(-(best @ model["out"] + model["out_bias"][0]).astype(float)))


def _gradients(model: dict, blobs: Sequence[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the log loss. Only chunks that hold a unit's highest value take part, so only they are worked out again."""
    best, where = _pooled(model, blobs)
    p = 1 / (1 + np.exp(-(best @ model["out"] + model["out_bias"][0])))
    err = ((p - y) * weight / len(y)).astype(np.float32)
    grad = {"out": best.T @ err, "out_bias": err.sum(keepdims=True)}
    pick, inverse = np.unique(np.stack([np.repeat(np.arange(len(blobs)), HIDDEN), where.ravel()]), axis=1,
                              return_inverse=True)
    raw = np.concatenate([np.frombuffer(blobs[d][c * HALF:(c + 3) * HALF].ljust(3 * HALF, b"\0"), np.uint8)
                          for d, c in pick.T])
    x, z = _filtered(model, raw)
    per = HALF // STEP
    cube = z.reshape(-1, 3 * per, FILTERS)[:, :2 * per]
    top, mean = cube.argmax(axis=1), cube.mean(axis=1)
    rows = np.arange(len(cube))[:, None]
    pooled = np.concatenate([cube[rows, top, np.arange(FILTERS)], mean], axis=1)
    act = np.tanh(pooled @ model["mid"] + model["mid_bias"])
    d_act = np.zeros_like(act)
    np.add.at(d_act, (inverse.ravel(), np.tile(np.arange(HIDDEN), len(blobs))),
              (err[:, None] * model["out"]).ravel())
    d_mid = d_act * (1 - act * act)
    grad |= {"mid": pooled.T @ d_mid, "mid_bias": d_mid.sum(axis=0)}
    d_pool = d_mid @ model["mid"].T
    d_z = np.zeros((len(cube), 3 * per, FILTERS), np.float32)
    d_z[:, :2 * per] = d_pool[:, None, FILTERS:] / (2 * per)
    d_z[rows, top, np.arange(FILTERS)] += d_pool[:, :FILTERS]
    d_z = d_z.reshape(-1, FILTERS) * (z > 0)
    grad |= {"near": x.T @ d_z, "far": x[1:].T @ d_z[:-1], "bias": d_z.sum(axis=0)}
    d_x = d_z @ model["near"].T
    d_x[1:] += d_z[:-1] @ model["far"].T
    d_embed = np.zeros_like(model["embed"])
    flat = d_x.reshape(-1, EMBED)
    for k in range(EMBED):
        d_embed[:, k] = np.bincount(raw, flat[:, k], 256)
    return grad | {"embed": d_embed}


def train(blobs: Sequence[bytes], labels: np.ndarray, seed: int = 5, share: float | None = None,
          steps: int = STEPS) -> dict[str, np.ndarray]:
    """Adam on the log loss, classes weighted to ``share`` of label 1 (by default the rows' own). With rows of one class
    only every text gets a score near that class, without any row 0.5."""
    model = initial(seed)
    y = np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        model["out"][:] = 0
        model["out_bias"][:] = 0 if len(y) == 0 else (8 if y[0] else -8)
        return model
    share = float(y.mean()) if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    r, step = np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    while step < steps:
        order = r.permutation(len(y))
        for at in range(0, len(y), BATCH):
            step += 1
            if step > steps:
                break
            pick = order[at:at + BATCH]
            rate = RATE * (1 - step / (steps + 1))
            for k, g in _gradients(model, [blobs[i] for i in pick], y[pick], weight[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                model[k] = (model[k] - rate * move).astype(np.float32)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE,
                seed: int = 5) -> dict[str, np.ndarray]:
    """The model from at most ``sample`` labelled rows of each class, none of the held-out fold. Labels other than 0 and
    1, and labels without a document or id, are left out."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")) \
        .where(F.col("doc_id").isNotNull() & ~in_fold("doc_id", folds, held_out))
    # Without the one class or the other no share is needed.
    counts = usable.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    share = counts[1] / (counts[0] + counts[1]) if counts[0] + counts[1] else None
    chosen = [usable.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    # At most 2 * sample ids and labels.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        data = (pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "text": [], "label": []})) \
            .sort_values(["doc_id", "text"], kind="stable")
        model = train([t.encode("utf-8", "replace") for t in data["text"]], data["label"].to_numpy(), seed,
                      share)
        out = io.BytesIO()
        np.savez(out, **model)
        yield pd.DataFrame({"model": [out.getvalue()]})

    row = rows.select("doc_id", "text", "label").repartition(1).mapInPandas(released(run), "model binary").first()
    if row is None:
        return train([], np.zeros(0))
    return dict(np.load(io.BytesIO(bytes(row.model))))


def score_texts(docs: DataFrame, model: dict[str, np.ndarray], out: str = "score") -> DataFrame:
    """The columns of ``docs`` and ``out``, the probability of label 1 from the whole text. A null text is empty; an
    empty text is one chunk of zeros. ``out`` must not be a column of ``docs``."""
    if free_name(out, docs.columns) != out:
        raise ValueError(f"column {out} is there already")
    at = [c.lower() for c in docs.columns].index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts = [t or b"" for t in part.column(at).cast(pa.large_binary()).to_pylist()]
                columns = [*part.columns, pa.array(probabilities(model, texts), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out])

    return docs.mapInArrow(released(run), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per document. Null ids are scored like others (their crc32 is that of
    empty text); repeated rows get the same score; other columns are not looked at; an empty table gives no rows."""
    model = fit_quality(docs, labels, folds, held_out)
    scored = score_texts(docs.select("doc_id", F.col(quoted("text"))), model)
    return scored.select("doc_id", in_fold("doc_id", folds, held_out).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
