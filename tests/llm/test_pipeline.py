"""Each stage of the corpus pipeline on what the one before kept, against brute force; odd rows and an empty table."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_edges import WORD, lower

import corpus_pipeline
from hindcast.llm import byte_cnn, mixing
from hindcast.session import materialize, shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark):
    """The smallest tables with odd rows and columns that carry names of the operators."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = {c: F.lit(v) for c, v in {"row": "r", "score": 0.5, "target": 1, "copy": "c", "label": 1, "mix_size": 7}.items()}
    odd = [(9001, None, "en", "web", None), (9002, "", "en", None, 0), (9003, " \t\n", None, "web", 3), (None, "no id at all", "en", "web", 12),
           (9004, "twice the same", "en", "web", 14), (9004, "twice the same", "en", "web", 14), (9005, "TWICE the same", "en", None, 14)]
    long = docs.where("n_chars > 3000").limit(1).withColumn("doc_id", F.lit(9006).cast("bigint"))
    near = long.withColumn("doc_id", F.lit(9007).cast("bigint")).withColumn("text", F.concat("text", F.lit(" one more word")))
    rows = docs.unionByName(spark.createDataFrame(odd, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)) \
        .unionByName(long).unionByName(near).withColumns(extra)
    path = shared_dir(spark)
    rows.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def facts(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def largest(rows):
    return max(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def shingles(text):
    words = tuple(lower(w) for w in WORD.findall(text or ""))
    return frozenset(words[i:i + 5] for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([words] if words else [])


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "exact_dedup", "near_duplicates", "source_mixing", "sentencepiece"]

    kept = materialize(steps["quality_classifier"](spark, docs, sf_dir))
    assert kept.columns == columns
    model = byte_cnn.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    all_rows = docs.collect()
    scores = byte_cnn.probabilities(model, [(r.text or "").encode() for r in all_rows])
    want = Counter((r.doc_id, r.text, r.source) for r, s in zip(all_rows, scores) if s >= corpus_pipeline.THRESHOLD)
    got = facts(kept)
    close = {(r.doc_id, r.text, r.source) for r, s in zip(all_rows, scores) if abs(s - corpus_pipeline.THRESHOLD) < 1e-4}
    assert all(k in close for k in (got - want) + (want - got)) and 50 < sum(got.values()) < len(all_rows)

    # From here on all documents, so that the odd ones are met too.
    kept = materialize(steps["exact_dedup"](spark, docs, sf_dir))
    texts = defaultdict(list)
    for r in all_rows:
        texts[lower(r.text or "")].append((r.doc_id, r.text, r.source))
    assert kept.columns == columns and len(facts(kept)) == kept.count() == len(texts)
    assert {k[0] for k in facts(kept)} == {largest(own)[0] for own in texts.values()}

    rows = kept.collect()
    near = materialize(steps["near_duplicates"](spark, kept, sf_dir))
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i)].append((r.doc_id, r.text, r.source))
    assert near.columns == columns and {k[0] for k in facts(near)} == {largest(own)[0] for own in classes.values()}
    assert near.count() == len(classes) < len(rows)

    mixed = materialize(steps["source_mixing"](spark, near, sf_dir))
    copies = Counter({(r.doc_id, r.text, r.source): r.mix_copies for r in mixing.mix_sources(near.drop("mix_size")).collect()})
    assert mixed.columns == columns and facts(mixed) == +copies

    encoded = steps["sentencepiece"](spark, mixed, sf_dir)
    found = Counter((r.doc_id, r.sample) for r in encoded.where("decoded").collect())
    per_doc = Counter(k[0] for k in facts(mixed).elements())
    assert {d: found[d, 0] for d in per_doc} == dict(per_doc)
    assert encoded.where("NOT decoded").count() == 0


def test_run_and_empty_table(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "pieces"} <= set(out.columns)
    empty = shared_dir(spark)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, empty).columns == docs.columns
