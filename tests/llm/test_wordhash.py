"""Words that collide under every polynomial modulo 2^64 are different words here."""

import random

import numpy as np

from hindcast.llm import jaccard_join, substring_dedup
from hindcast.llm.wordhash import Words


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


ONE, TWO = thue_morse(2048, 0), thue_morse(2048, 1)


def test_words_and_runs():
    r = random.Random(1)
    texts = [" ".join(r.choices(["a", "B", "bé", ONE, TWO], k=30)) for _ in range(20)] + ["", None, "\x1c  x\x0by"]
    w = Words(texts)
    split = [(t or "").encode().split() for t in texts]
    flat = [x for s in split for x in s]
    assert list(np.diff(w.first)) == [len(s) for s in split]
    assert w.hash[flat.index(ONE.encode())] == w.hash[flat.index(TWO.encode())]  # the quick hash does collide
    w.make_sure(np.arange(len(flat)))
    for which in (0, 1):
        assert len(set(w.sure[which].tolist())) == len(set(flat))
        runs = w.runs(5, which)
        seen = {}
        for i in np.flatnonzero(w.inside(5)):
            key = tuple(flat[i:i + 5])
            assert seen.setdefault(key, runs[i]) == runs[i]
        assert len(set(seen.values())) == len(seen)
    one, two = Words(["Ab É"], lower=True), Words(["ab É"])
    for x in (one, two):
        x.make_sure(np.arange(2))
    assert (one.hash == two.hash).all() and (one.sure == two.sure).all()


def test_chosen_words_share_no_window(spark):
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{ONE} {rest}"), (2, f"{TWO} {rest}"), (3, f"{ONE} {rest}")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    near = {r.doc_id: (r.class_id, r.copies) for r in jaccard_join.link_documents(docs).collect()}
    assert near[1][1] == near[3][1] == 2 and near[2][1] == 1
