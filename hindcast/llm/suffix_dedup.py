"""Remove bytes that stand earlier in the corpus as part of an equal string of SPAN bytes.

The sorted suffixes of whole documents do not fit a task, so the collection is dealt by content first, and each share is a
collection of its own for the column-wise construction (``column_bwt``). Every SPAN bytes have a key: the least hash of the
GRAM-byte strings in them, so equal strings have equal keys. Starts side by side with one key make a piece of text. Keys
that occur once in the corpus cannot hold repeats, and most do: batches of documents tell buckets of keys what they have,
and are told which keys occur again. Only pieces of those are sent, equal pieces as one, and each share says which starts are
the first of their SPAN bytes; all other starts with a key that occurs again are repeats.

A key that more than HOT strings have (a passage that a third of the documents cite, each in other words) does not gather in
one share: its pieces are sent start by start, dealt by the bytes themselves, equal ones as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.column_bwt import SPAN, first_spans
from hindcast.llm.common import text_of, total_of
from hindcast.llm.wordhash import mix

GRAM = 48
GRAMS = SPAN - GRAM + 1  # in SPAN bytes
HOT = 4096
BATCH_BYTES, BUCKET_BYTES, SHARE_BYTES = 4 << 20, 12 << 20, 1 << 20  # text per batch, per bucket of keys, per share
KEY_BYTES = 6
CHUNK = 1 << 17  # bytes hashed at a time, so that they stay in the processor's cache
LEAST = -(1 << 63)
ORDER = ["order_id", "tie"]


def _step(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out += right
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _over(values: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of GRAMS values from each place on."""
    reach = 1
    while 2 * reach <= GRAMS:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    rest = GRAMS - reach
    return pick(values[:-rest], values[rest:])


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    eight = _step(np.ndarray(len(data) - 7, "<u8", data, strides=(1,)), np.uint64(7))
    sixteen = _step(eight[:-8], eight[8:])
    half = _step(sixteen[:-16], sixteen[16:])
    return _step(half[:len(data) - GRAM + 1], sixteen[32:])


def span_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the SPAN bytes from each place on, the least hash of their GRAM-byte strings; and the keys that may have two equal
    strings in one stretch of starts: those whose GRAM bytes stand twice within GRAMS places."""
    count = max(0, len(data) - SPAN + 1)
    out, twice = np.empty(count, np.uint64), [np.zeros(0, np.uint64)]
    for lo in range(0, count, CHUNK):
        grams = _grams(np.ascontiguousarray(data[max(0, lo - GRAMS):min(lo + CHUNK, count) + SPAN - 1]))
        key = _over(grams, np.minimum)
        out[max(0, lo - GRAMS):lo + CHUNK] = key
        # A hash is some start's key if it equals the largest key of the starts that hold it.
        spread = np.zeros(len(key) + 2 * (GRAMS - 1), np.uint64)
        spread[GRAMS - 1:GRAMS - 1 + len(key)] = key
        at = np.flatnonzero(grams == _over(spread, np.maximum))
        again = (grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) <= GRAMS)
        twice.append(grams[at[1:][again]])
    return out, np.unique(np.concatenate(twice))


def pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES:]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // KEY_BYTES, 8), np.uint8)
    out[:, 8 - KEY_BYTES:] = np.frombuffer(blob, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel().astype(np.uint64)


def _narrow(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(8 * (8 - KEY_BYTES)) << np.uint64(8 * (8 - KEY_BYTES))


class _Batch:
    """Documents in their order, their bytes side by side, and the pieces of starts with one key."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([(c, "ascending") for c in ORDER])
        self.table = table
        texts = table.column("text").to_pylist()
        self.order = list(zip(table.column("order_id").to_pylist(), table.column("tie").to_pylist()))
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.bytes = b"".join(texts)
        del texts
        self.data = np.frombuffer(self.bytes, np.uint8)
        key, twice = span_keys(self.data)
        # Starts whose SPAN bytes lie in one document.
        change = np.zeros(len(key) + 1, np.int8)
        for a, b in zip(self.begin[:-1].tolist(), self.begin[1:].tolist()):
            if b - a >= SPAN:
                change[a] += 1
                change[b - SPAN + 1] -= 1
        inside = np.cumsum(change[:-1], dtype=np.int8) > 0
        head = inside.copy()
        head[1:] &= (key[1:] != key[:-1]) | ~inside[:-1]
        starts = np.array([a for a, b in zip(self.begin[:-1], self.begin[1:]) if b - a >= SPAN], np.int64)
        head[starts] = True
        first = np.flatnonzero(head)
        stop = np.zeros(len(key) + 1, bool)
        stop[1:] = inside
        stop[:-1] &= ~inside | head
        stop[-1] = len(inside) > 0 and inside[-1]
        last = np.flatnonzero(stop)
        last = last[last > 0]
        # Long stretches with one key, as in a text that repeats one byte, are cut.
        parts = (last - first + GRAMS - 1) // GRAMS
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = np.repeat(first, parts) + nth * GRAMS
        self.last = np.minimum(np.repeat(last, parts), self.first + GRAMS)  # one past the last start
        self.key = mix(key[self.first])
        self.twice = mix(twice)

    def key_rows(self, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
        keys, count = np.unique(self.key, return_counts=True)
        count = np.minimum(count + np.isin(keys, self.twice), 65535).astype("<u2")
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, at = np.unique(bucket[order], return_index=True)
        for b, own in zip(found.tolist(), np.split(order, at[1:])):
            yield b, pack(keys[own]), count[own].tobytes()

    def repeated(self, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of the pieces: whether their key occurs again, and whether it is hot."""
        narrow = _narrow(self.key)
        out = []
        for column in ("keys", "hot"):
            known = np.concatenate([np.zeros(0, np.uint64), *[unpack(b) for b in told.column(column).to_pylist() if b]])
            out.append(np.isin(narrow, known))
        return out[0], out[1]

    def piece_rows(self, told: pa.Table) -> pa.Table:
        hit, hot = self.repeated(told)
        doc = np.searchsorted(self.begin, self.first, "right") - 1
        seen: dict[bytes, None] = {}
        rows: list[tuple[int, int, int]] = []  # (document, start in it, key)
        for i in np.flatnonzero(hit & ~hot).tolist():
            a = int(self.first[i])
            piece = self.bytes[a:int(self.last[i]) + SPAN - 1]
            if piece not in seen:
                seen[piece] = None
                rows.append((int(doc[i]), a - int(self.begin[doc[i]]), int(self.key[i]) >> 1))
        many = np.flatnonzero(hit & hot)
        for i in many.tolist():
            for a in range(int(self.first[i]), int(self.last[i])):
                piece = self.bytes[a:a + SPAN]
                if piece not in seen:
                    seen[piece] = None
                    rows.append((int(doc[i]), a - int(self.begin[doc[i]]), None))
        return pa.table([pa.array([r[2] for r in rows], pa.int64()), pa.array(list(seen), pa.binary()),
                         pa.array([self.order[r[0]][0] for r in rows], pa.int64()),
                         pa.array([self.order[r[0]][1] for r in rows], pa.int64()),
                         pa.array([r[1] for r in rows], pa.int64())], names=["key", "piece", *ORDER, "start"])

    def result(self, told: pa.Table, with_spans: bool) -> pa.Table:
        hit, _ = self.repeated(told)
        change = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(change, self.first[hit], 1)
        np.add.at(change, self.last[hit], -1)
        repeat = np.cumsum(change)[:-1] > 0  # starts with a key that occurs again
        first_byte: dict[tuple[int, int], int] = {}
        for n, order in enumerate(self.order):
            first_byte.setdefault(order, int(self.begin[n]))
        firsts = told.filter(told.column("firsts").is_valid())
        for order_id, tie, start, bits in zip(*(firsts.column(c).to_pylist() for c in (*ORDER, "start", "firsts"))):
            at = first_byte[order_id, tie] + start
            own = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)[:len(self.data) - at]
            repeat[at:at + len(own)] &= ~own
        change[:] = 0
        where = np.flatnonzero(repeat)
        change[where] += 1
        np.add.at(change, where + SPAN, -1)
        gone = np.cumsum(change)[:-1] > 0
        n_bytes, removed, shas, spans, kept_bytes = [], [], [], [], []
        for a, b in zip(self.begin[:-1].tolist(), self.begin[1:].tolist()):
            own = gone[a:b]
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            kept = self.data[a:b][~own].tobytes() if len(edges) else self.bytes[a:b]
            n_bytes.append(b - a)
            removed.append(b - a - len(kept))
            shas.append(hashlib.sha256(kept).hexdigest())
            spans.append([{"start": int(s), "length": int(e - s)} for s, e in edges.reshape(-1, 2)])
            kept_bytes.append(kept)
        columns = {"doc_id": self.table.column("doc_id"), "copies": self.table.column("copies"),
                   "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                   "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
        if with_spans:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            columns |= {"spans": pa.array(spans, kind), "kept": pa.array(kept_bytes, pa.binary())}
        return pa.table(columns)


def _meet_keys(table: pa.Table) -> pa.Table:
    """Per batch of a bucket, its keys that occur twice or more, and those that more than HOT strings have."""
    blobs, counts, batches = (table.column(c).to_pylist() for c in ("keys", "counts", "batch"))
    key = np.concatenate([unpack(b) for b in blobs])
    count = np.concatenate([np.frombuffer(c, "<u2") for c in counts]).astype(np.int64)
    batch = np.repeat(np.arange(len(blobs)), [len(c) // 2 for c in counts])
    order = np.argsort(key, kind="stable")
    key, count, batch = key[order], count[order], batch[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.repeat(np.add.reduceat(count, head), np.diff(np.append(head, len(key))))
    rows = []
    own = np.flatnonzero(times > 1)
    own = own[np.argsort(batch[own], kind="stable")]
    found, at = np.unique(batch[own], return_index=True)
    for b, mine in zip(found.tolist(), np.split(own, at[1:])):
        rows.append((batches[b], pack(key[mine]), pack(key[mine[times[mine] > HOT]])))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                     pa.array([r[2] for r in rows], pa.binary())], names=["batch", "keys", "hot"])


def _share(table: pa.Table) -> pa.Table:
    """Of the distinct pieces of a share, those with starts that are the first of their SPAN bytes, as bits."""
    order = [table.column(c).to_numpy() for c in (*ORDER, "start")]
    by = np.lexsort(order[::-1])
    new = np.ones(len(by), bool)
    new[1:] = (order[0][by][1:] != order[0][by][:-1]) | (order[1][by][1:] != order[1][by][:-1])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    first = first_spans(table.column("piece").to_pylist(), (rank << 32) + order[2])
    some = np.flatnonzero([f.any() for f in first])
    taken = table.take(pa.array(some))
    bits = pa.array([np.packbits(first[i]).tobytes() for i in some], pa.binary())
    return pa.table([taken.column("order_id"), taken.column("tie"), taken.column("start"), bits],
                    names=[*ORDER, "start", "firsts"])


def remove_repeated_bytes(docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]), a row per document.

    Texts are read as UTF-8 bytes. Removed is each byte in a string of SPAN bytes that also starts earlier: in a document with a
    smaller id, or earlier in the same document; strings are judged on the input and do not cross documents. ``n_spans``
    counts the maximal removed stretches (``spans``: start and length of each); what is left is joined (``kept``, as bytes, for
    a cut may fall into a character). A null text is empty. A null id comes before all others; rows that share an id are
    documents after each other, in the order of a hash of their texts, and rows that share both are collapsed to one before
    the work: the first is judged, and its copies repeat it. Other columns are not looked at; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LEAST)).cast("long").alias("order_id"),
                       F.xxhash64(text_of()).alias("tie"), text_of().cast("binary").alias("text"))
    twice = rows.groupBy(F.col("doc_id"), "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if twice.count():
        rows = rows.groupBy("doc_id", *ORDER, "text").agg(F.count(F.lit(1)).alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    size = total_of(docs, F.octet_length(text_of()).cast("long"))
    batches, buckets, shares = (size // n + 1 for n in (BATCH_BYTES, BUCKET_BYTES, SHARE_BYTES))
    of_order = F.pmod(F.xxhash64(*ORDER), F.lit(batches))
    dealt = rows.select(of_order.alias("batch"), "*")

    def keys(group: tuple, table: pa.Table) -> pa.Table:
        found = list(_Batch(table).key_rows(buckets))
        return pa.table([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.binary()),
                         pa.array([r[2] for r in found], pa.binary()), pa.array([group[0].as_py()] * len(found), pa.int64())],
                        names=["bucket", "keys", "counts", "batch"])

    told = dealt.groupBy("batch").applyInArrow(keys, "bucket long, keys binary, counts binary, batch long") \
        .groupBy("bucket").applyInArrow(_meet_keys, "batch long, keys binary, hot binary")

    def cut(table: pa.Table, hits: pa.Table) -> pa.Table:
        return _Batch(table).piece_rows(hits)

    position = f"{ORDER[0]} long, {ORDER[1]} long, start long"
    pieces = dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        cut, f"key long, piece binary, {position}")
    share = F.pmod(F.coalesce("key", F.xxhash64("piece")), F.lit(shares)).alias("share")
    # Dealt by share once: equal pieces become one, in a sort that can spill, and the shares are formed where they lie.
    distinct = pieces.select(share, "*").repartition("share").groupBy("share", "key", "piece") \
        .agg(F.min(F.struct(*ORDER, "start")).alias("at")).select("share", "piece", "at.*")
    firsts = distinct.groupBy("share").applyInArrow(_share, f"{position}, firsts binary").withColumn("batch", of_order)
    replies = told.unionByName(firsts, allowMissingColumns=True)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _Batch(table).result(answers, with_spans)

    kinds = {"doc_id": "long", "copies": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long",
             "kept_sha256": "string"}
    if with_spans:
        kinds |= {"spans": "array<struct<start:long,length:long>>", "kept": "binary"}
    judged = dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        finish, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    nth = judged.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    whole = (F.col("nth") > 1) & (F.col("n_bytes") >= SPAN)
    changed = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    if with_spans:
        changed |= {"spans": F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length"))),
                    "kept": F.lit("").cast("binary")}
    return nth.select(*[F.when(whole, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
                        for c in kinds if c != "copies"])
