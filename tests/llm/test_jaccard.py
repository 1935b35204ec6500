"""The Jaccard join against all pairs, on small texts."""

import random
import re

import numpy as np
import pytest

from hindcast.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, Row int, label string"


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """{doc_id: (class_id, n_links, copies)} for rows with distinct ids."""
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(shingles(text), []).append(doc_id)
    keys = list(sets)
    links, root = {k: 0 for k in keys}, {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in range(len(keys)):
        for y in range(x):
            a, b = keys[x], keys[y]
            both = len(a & b)
            if a and b and 5 * both >= 4 * (len(a) + len(b) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in keys:
        least[find(k)] = min([least.get(find(k), 1 << 60), *sets[k]])
    return {d: (least[find(k)], links[k], len(sets[k])) for k in keys for d in sets[k]}


def edited_texts(seed=3, families=25, size=12):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(400)]
    rows, doc_id = [], 0
    for f in range(families):
        words = r.choices(vocabulary, k=r.choice([6, 30, 80, 200]))
        for _ in range(r.randint(1, size)):
            own = list(words)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((doc_id, " ".join(own).upper() if r.random() < 0.1 else "  ".join(own)))
            doc_id += 1
    return rows


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 4])
def test_links_and_classes(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = edited_texts() + [(900, ""), (901, None), (902, "one two"), (903, "ONE two"), (904, "one three")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = {r.doc_id: (r.class_id, r.n_links, r.copies) for r in jaccard_join.link_documents(df).collect()}
    assert got == brute(rows)


def test_matrix_form_of_large_tiles():
    sets = [np.array(sorted(s), np.uint64) for s in ([1, 2, 3], [2, 3, 4], [9], [2, 9])]
    want = [[len(np.intersect1d(a, b)) if len(set(a) & set(b)) else 0 for b in sets] for a in sets]
    got = jaccard_join._common(sets)
    assert all(got[x, y] == want[x][y] for x in range(4) for y in range(4) if x != y)


def test_many_near_copies(spark):
    """A group whose pairs go through the matrix form."""
    r = random.Random(1)
    words = ["".join(r.choices("abcd", k=5)) for _ in range(60)]
    rows = []
    for i in range(120):
        own = list(words)
        own[r.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.class_id, x.n_links, x.copies) for x in jaccard_join.link_documents(df).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "A b c d e f"), (5, "x"), (5, "x")],
                               "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id, r.class_id, r.copies) for r in jaccard_join.link_documents(df).collect())
    assert [g[2:] for g in got] == [(5, 3), (5, 3), (5, 2), (5, 2), (5, 3)]
    kept = jaccard_join.drop_near_duplicates(df).collect()
    assert sorted(r.text for r in kept) == ["A b c d e f", "x"]
    assert jaccard_join.link_documents(df.where("false")).collect() == []


def test_bounds_keep_pairs_at_the_threshold():
    need = jaccard_join.needed()
    assert need[128] < 0.8 * 128 and all(need[n] < n for n in need)
    for n in need:  # the chance that a pair at the threshold matches less often
        from math import comb
        lost = sum(comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(need[n]))
        assert lost < 1e-6
