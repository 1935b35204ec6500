"""Squares and runs against a plain search, however the sequence is cut; documents with odd input."""

import random

import numpy as np
import pytest
from test_edges import LONG, WORD, frame

from hindcast.llm import periodic_runs, squares


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(count):
    r = random.Random(5)
    for _ in range(count):
        n = r.choice([0, 11, 12, 13, 40, 77, 150, 300])
        words = r.choices(range(r.choice([1, 2, 3, 6])), k=n)
        if n and r.random() < 0.5:
            a, p = r.randrange(n), r.randrange(1, max(2, n // 2))
            words[a:] = [words[a + i % p] for i in range(n - a)]
        if n and r.random() < 0.2:
            one, two = [0], [0, 1]
            while len(two) < n:
                one, two = two, two + one * r.choice([1, 1, 2])
            words = two[:n]
        yield words


@pytest.mark.parametrize("step", [1, 7, 64, 1000])
def test_runs_of_sequences(step):
    for words in sequences(80):
        online = squares.Squares(len(words))
        for at in range(0, len(words), step):
            online.append(words[at:at + step])
        assert [tuple(x) for x in online.runs().T.tolist()] == plain_runs(words)


def test_squares_are_reported_when_they_end():
    words = [9, 8, *[1, 2, 3, 4, 5, 6] * 3, 7]
    online, ends = squares.Squares(len(words)), []
    for n, w in enumerate(words, 1):
        ends += [(int(s), int(q), n) for s, q, first, last in online.append([w]).T if first <= n <= last]
    assert ends == [(2, 6, n) for n in range(14, 21)]
    assert online.runs().T.tolist() == [[2, 18, 6]]


def test_hash_that_lies(monkeypatch):
    """One hash for all runs of four and more numbers: what is reported is checked, and read again under another salt."""
    real = squares.Squares._hash

    def lying(self, new):
        real(self, new)
        if self.salt < 2:
            for h in self.hashes[2:]:
                h[:] = 0

    monkeypatch.setattr(squares.Squares, "_hash", lying)
    for words in sequences(20):
        online = squares.Squares(len(words))
        online.append(words)
        assert [tuple(x) for x in online.runs().T.tolist()] == plain_runs(words)


def test_documents(spark):
    r = random.Random(3)
    texts = [None, "", " \t\n", "a " * 11, "a " * 12, "á " * 30 + "b", LONG, LONG + " " + LONG]
    texts += [" ".join(r.choices("abé", k=r.choice([5, 60, 200]))) + r.choice(["", "\x0b\r\n "]) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x y " * 9)] * 2 + [(5, "x y " * 9), (5, None)]
    got = [(d.doc_id, d.n_words, [tuple(x) for x in d.runs], d.collapsed)
           for d in periodic_runs.find_runs(frame(spark, rows)).collect()]
    want = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        if text == LONG + " " + LONG:
            runs = [(0, 120_000, 60_000)]
        else:
            runs = plain_runs(words) if len(words) < 1000 else []
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        want.append((doc_id, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    key = lambda x: (x[0] is None, x[0] or 0, str(x))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert periodic_runs.find_runs(frame(spark, [])).collect() == []


def test_planted_period(spark):
    from zlib import crc32
    rows = [(i, " ".join(f"w{j}" for j in range(i % 50))) for i in range(300)] + [(None, "a b c"), (7, None)]
    got = {(r.doc_id, r.text) for r in periodic_runs.with_planted_period(frame(spark, rows)).collect()}
    for doc_id, text in rows:
        words = (text or "").split()
        h = crc32(b"" if doc_id is None else str(doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[a + (i - a) % p] if i >= a else words[i] for i in range(n))
        assert (doc_id, text or "") in got


def test_long_and_short_documents_share_a_group():
    r = np.random.default_rng(1)
    long_ = [b"%d" % x for x in r.integers(0, 50, 3000)] * 2
    short = [b"x", b"y"] * 8
    runs = periodic_runs.document_runs([short, long_, [], short])
    assert runs[0].T.tolist() == runs[3].T.tolist() == [[0, 16, 2]]
    assert [0, 6000, 3000] in runs[1].T.tolist() and not runs[2].size
