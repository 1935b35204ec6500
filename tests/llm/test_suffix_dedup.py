"""Repeats of 100 bytes against a plain search, in the collection of a share and over whole tables."""

import hashlib
import random

import numpy as np
import pytest
from test_edges import LONG, frame

from hindcast.llm import column_bwt, suffix_dedup
from hindcast.llm.column_bwt import SPAN, first_spans


def plain_firsts(pieces, rank):
    best = {}
    for p, k in zip(pieces, rank):
        for o in range(len(p) - SPAN + 1):
            best[p[o:o + SPAN]] = min(best.get(p[o:o + SPAN], 1 << 62), k + o)
    return [[best[p[o:o + SPAN]] == k + o for o in range(max(0, len(p) - SPAN + 1))] for p, k in zip(pieces, rank)]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(256))])
def test_collection(alphabet):
    r = random.Random(len(alphabet))
    for _ in range(40):
        base, pieces = bytes(r.choices(alphabet, k=400)), []
        for _ in range(r.choice([0, 1, 3, 30])):
            a, n = r.randrange(300), r.choice([100, 100, 101, 120, 135, 152, 160, 99, 5, 0])
            p = bytearray(base[a:a + n])
            if p and r.random() < 0.3:
                p[r.randrange(len(p))] = r.randrange(256)
            pieces.append(bytes(p))
        rank = [i << 32 for i in range(len(pieces))]
        r.shuffle(rank)
        assert [f.tolist() for f in first_spans(pieces, np.array(rank, np.int64))] == plain_firsts(pieces, rank)


def test_names_where_hashes_collide(monkeypatch):
    real, calls = column_bwt.mix, []

    def lying(x):
        calls.append(1)
        return real(x) & np.uint64(1) if len(calls) <= 3 else real(x)

    monkeypatch.setattr(column_bwt, "mix", lying)
    data = np.frombuffer(bytes(random.Random(1).choices(b"abc", k=300)), np.uint8)
    names = column_bwt.symbol_names(data, np.arange(len(data) - column_bwt.WIDE + 1))
    said = [data[i:i + column_bwt.WIDE].tobytes() for i in range(len(names))]
    assert len(set(zip(said, names.tolist()))) == len(set(said)) == len(set(names.tolist())) and len(calls) > 3


def test_equal_strings_have_equal_keys():
    r = random.Random(4)
    data = bytes(r.choices(b"ab c", k=3000)) + b"x" * 400 + bytes(r.choices(b"abcd", k=300)) * 3
    key, twice = suffix_dedup.span_keys(np.frombuffer(data, np.uint8))
    seen = {}
    for i, k in enumerate(key.tolist()):
        assert seen.setdefault(data[i:i + SPAN], k) == k
    assert len(twice) and suffix_dedup.span_keys(np.frombuffer(data[:99], np.uint8))[0].size == 0


def plain(rows):
    """Rows of (doc_id, n_bytes, n_removed, n_spans, sha, kept), documents by id and then a given order of texts."""
    seen, out = set(), []
    for doc_id, data in rows:
        gone = bytearray(len(data))
        for i in range(len(data) - SPAN + 1):
            s = data[i:i + SPAN]
            if s in seen:
                gone[i:i + SPAN] = b"\x01" * SPAN
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus():
    r = random.Random(7)
    words = ["été", "of", "the", "日本", "lorem", "ipsum-dolor", "x"]
    base = " ".join(r.choices(words, k=600))
    texts = [None, "", "a" * 99, "a" * 100, "a" * 350, "ab" * 90, base, base, base[50:900] + "!" + base[300:]]
    for _ in range(40):
        a = r.randrange(2000)
        texts.append(" ".join(r.choices(words, k=r.randrange(80))) + base[a:a + r.choice([60, 130, 400])]
                     + " ".join(r.choices(words, k=r.randrange(80))))
    texts += ["line of some words that comes again and again\n" * 9, "0123456789" * 10 + "q" + "0123456789" * 10]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot,batch,long", [(4096, 4 << 20, True), (4096, 8_000, False), (0, 8_000, False)])
def test_documents(spark, monkeypatch, hot, batch, long):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3 * batch)
    monkeypatch.setattr(suffix_dedup, "SHARE_BYTES", batch)
    rows = corpus() + [(500, LONG[:200_000]), (501, LONG[1000:2000] + LONG[:400])] * long
    want = sorted(plain([(i, (t or "").encode()) for i, t in rows]))
    found = suffix_dedup.remove_repeated_bytes(frame(spark, rows), with_spans=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in found) == want
    assert all(sum(s.length for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in found)


def test_repeated_rows_and_ids(spark):
    a, b = "some text with more than a hundred bytes " * 4, "another text, also more than a hundred bytes " * 4
    rows = [(1, a)] * 5 + [(1, b), (1, None), (1, None), (None, b), (None, b), (2, a + b), (3, "short"), (3, "short")]
    got = suffix_dedup.remove_repeated_bytes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_bytes), []).append((r.n_removed, r.n_spans))
    own = dict((n, (gone, spans)) for _, n, gone, spans, _, _ in plain([(0, a.encode()), (0, b.encode())]))
    assert sorted(by[1, len(a)]) == sorted([own[len(a)]] + [(len(a), 1)] * 4)
    assert by[1, len(b)] == [(len(b), 1)]  # the rows without an id come first
    assert sorted(by[None, len(b)]) == sorted([own[len(b)], (len(b), 1)])
    assert by[1, 0] == [(0, 0)] * 2 and by[3, 5] == [(0, 0)] * 2
    assert suffix_dedup.remove_repeated_bytes(frame(spark, [])).collect() == []
