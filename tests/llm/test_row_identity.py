"""Operators that drop rows keep one row of each text though the scan is cut differently when the result is read."""

import random

from test_edges import WORD

from hindcast.llm import exact_dedup, jaccard_join
from hindcast.session import shared_dir


def test_scan_cut_anew(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices("abcdefgh", k=30)) for _ in range(300)]
    rows = [(i, r.choice(texts), "x") for i in range(900)]
    path = shared_dir(spark)
    spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(6, "doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    wanted = {t for _, t, _ in rows}
    try:
        for drop in (exact_dedup.drop_duplicates, jaccard_join.drop_near_duplicates):
            spark.conf.set("spark.sql.files.minPartitionNum", "2")
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
            kept = drop(docs)
            spark.conf.set("spark.sql.files.minPartitionNum", "6")
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
            got = kept.collect()
            assert kept.columns == docs.columns
            if drop is exact_dedup.drop_duplicates:
                assert sorted(x.text for x in got) == sorted(wanted)
                assert {x.doc_id for x in got} == {max(i for i, t, _ in rows if t == w) for w in wanted}
            else:
                sets = {x.text: {tuple(WORD.findall(x.text)[i:i + 5]) for i in range(26)} for x in got}
                assert len(sets) == len(got) and len(got) > 200
    finally:
        for key in ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(key)
