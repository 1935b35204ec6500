"""Codes and codebooks against full search in plain integers, and what the bounds save."""

import hashlib
import math
import random

import numpy as np
import pytest

from hindcast.llm import vector_codes
from hindcast.llm.vector_codes import Codebooks, assign, compress, integers, with_label_errors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, code string, sums int"


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, label, code, error) in any order, and the last codebooks."""
    kept = [(i, [max(-2**25, min(2**25, math.floor(256 * x))) for x in v], label) for i, v, label in rows
            if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, v, _ in kept:
                got.setdefault(nearest(v, p)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(got[j]) for c in zip(*got[j])] if j in got else e for j, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", "c", 2) for i, v, label in rows], SCHEMA)


def as32(v):
    return [float(np.float32(x)) for x in v]


@pytest.mark.parametrize("dim,count,spread", [(16, 300, 0.02), (32, 200, 1.0), (64, 40, 5.0)])
def test_against_full_search(spark, dim, count, spread):
    r = random.Random(dim)
    rows = [(r.randrange(10**6), as32(r.choice([-1, 0, 2]) + r.gauss(0, spread) for _ in range(dim)), r.choice([None, 1, 2]))
            for _ in range(count)]
    rows += rows[:5] + [(None, as32([0.5] * dim), 1), (3, None, 1), (4, [], 1), (5, [1.0, None] * (dim // 2), 2),
                        (6, [float("nan")] * dim, 1), (7, [float("inf")] + [0.0] * (dim - 1), 1), (10**7, [1.0] * (dim + 1), 1),
                        (10**7, [1.0] * (2 * dim), 1), (10**7 + 1, as32([1e30, -1e30] * (dim // 2)), None)]
    want, books = plain(rows)
    coded, got_books = compress(frame(spark, rows))
    got = [tuple(x) for x in coded.select("id", "label", "code", "error").collect()]
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert got_books.history[-1].tolist() == books
    said = ",".join(str(c) for p in books for e in p for c in e)
    assert got_books.sha256() == hashlib.sha256(said.encode()).hexdigest()
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    assert {(x.label, x.label_error) for x in with_label_errors(coded).collect()} == set(totals.items())


def test_empty_table(spark):
    coded, books = compress(frame(spark, []))
    assert books is None and with_label_errors(coded).collect() == []
    coded, books = compress(frame(spark, [(1, None, 2)]))
    assert books is None and coded.collect() == []


def clustered(n, dim, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (80, dim))
    return integers(centres[r.integers(0, 80, n)] + r.normal(0, 0.05, (n, dim)))


def test_bounds_save_distances_and_history_is_tighter():
    """Over many rounds: codes of a full search, fewer distances, and still fewer than with moves added up."""
    x, parts = clustered(1500, 32), 4
    full, counts = len(x) * parts * 65, {}
    for net in (True, False):
        books = Codebooks([x[:64].reshape(64, parts, -1).swapaxes(0, 1).astype(np.int64)])
        state, counts[net] = None, 0
        for step in range(10):
            state, error, n = assign(x, state, books, books.displacements(net))
            plain_state, plain_error, _ = assign(x, None, Codebooks(books.history[-1:]), np.zeros((1, parts, 8)))
            assert (state[0] == plain_state[0]).all() and (error == plain_error).all()
            counts[net] += n if step else 0
            s = vector_codes._sums(x, state[0], books.history[0].shape)
            mean = np.where(s[:, :, -1:] > 0, s[:, :, :-1] // np.maximum(s[:, :, -1:], 1), books.history[-1])
            books = Codebooks([*books.history, mean])
    assert counts[True] < counts[False] < 9 * full
    assert counts[True] < 0.5 * 9 * full


def test_net_displacement_is_at_most_the_sum_of_moves():
    r = np.random.default_rng(2)
    books = Codebooks([r.integers(-99, 99, (3, 20, 5)) for _ in range(6)])
    net, added = books.displacements(), books.displacements(net=False)
    assert net.shape == added.shape == (5, 3, 8) and (net <= added + 1e-9).all() and (net[-1] == added[-1]).all()


def test_scale_of_large_numbers():
    x = np.array([[vector_codes.LIMIT] * 4, [-vector_codes.LIMIT] * 4], np.int32)
    assert vector_codes._squares(x, x.astype(np.int64)).tolist() == [[0, 4 * 2**52], [4 * 2**52, 0]]
