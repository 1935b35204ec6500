"""SimHash fingerprints of texts, their likeness, and the search for all fingerprints within a Hamming radius.

Terms are runs of five lower-cased words (a shorter text is one term), weighted by how often they occur. Each term's 128
hash bits vote on the signs of the fingerprint's bits. All of it is DataFrame expressions: terms are exploded and the
votes are sums, two bits of votes to a 64-bit sum, combined where the text is read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import SPACES, free_name, lower_ascii, text_of
from hindcast.functions.scalars import quoted
from hindcast.session import materialize

TERM_WORDS = 5
HALF = 64  # bits per hash; a fingerprint has two.
PAIR = (1 << 32) + 1


def terms(text: Column, words: int = TERM_WORDS) -> Column:
    """Hashes of all runs of ``words`` words; of all words together where there are fewer."""
    tokens = F.filter(F.split(lower_ascii(text), SPACES), lambda w: w != "")
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - words),
                                 lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
    # One step that names the array, so that it is not worked out again for each run.
    return F.element_at(F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= words, runs(h)).otherwise(
        F.array(F.xxhash64(h)))), 1)


def _votes() -> list[Column]:
    out = []
    for half in range(2):
        value = F.col("t") if half == 0 else F.xxhash64("t")
        for i in range(HALF // 2):
            both = F.shiftrightunsigned(value, i).bitwiseAND(F.lit(PAIR))
            out.append(F.sum(both).alias(f"v{half}_{i}"))
    return out


def _half(half: int) -> Column:
    """Bit i is set where more than half of the terms have it set; sums hold bit i low and bit i + 32 high."""
    bits = []
    for i in range(HALF // 2):
        low = F.col(f"v{half}_{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"v{half}_{i}", 32)
        for at, ones in ((i, low), (i + 32, high)):
            mark = 1 << at if at < 63 else -(1 << 63)
            bits.append(F.when(ones * 2 > F.col("n"), F.lit(mark)).otherwise(F.lit(0)).cast("long"))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def fingerprint(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, f0, f1): the two halves of each row's fingerprint; ``keys`` must be unique. The terms of a row are summed
    in the task that reads it; one row per key is shuffled."""
    exploded = rows.select(*keys, F.explode(terms(text)).alias("t"))
    summed = exploded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_votes())
    return summed.select(*keys, _half(0).alias("f0"), _half(1).alias("f1"))


def hexed(a: str, b: str) -> Column:
    one = lambda c: F.lpad(F.lower(F.hex(F.col(c))), 16, "0")
    return F.concat(one(a), one(b))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(2.0 * HALF)


def _key_tables(radius: int) -> list[list[tuple[int, int]]]:
    """Per table its two blocks as (first hex digit from 1, digits): of radius + 2 blocks two fingerprints within the
    radius share at least two, so each such pair meets in a table."""
    digits, count = HALF // 2, radius + 2
    edges = [round(i * digits / count) for i in range(count + 1)]
    blocks = [(a + 1, b - a) for a, b in zip(edges, edges[1:])]
    return [list(pair) for pair in combinations(blocks, 2)]


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(f0, f1, near): per distinct queried fingerprint the number of rows of ``prints`` within ``radius`` bits of it.

    Both tables have columns f0 and f1; equal fingerprints are counted first, so a group of copies is one row here.
    Permuted block tables: a pair is met in the first table whose blocks agree, and only pairs within the radius leave
    the join.
    """
    tables = _key_tables(radius)
    key = lambda fp, t: F.concat(*[F.substring(F.col(fp), a, n) for a, n in tables[t]])

    def spread(df: DataFrame, p: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(t).alias("t"), key(f"{p}fp", t).alias("k")) for t in range(len(tables))])
        return df.select("*", F.explode(entries).alias(f"{p}e")).select(
            "*", F.col(f"{p}e.t").alias(f"{p}t"), F.col(f"{p}e.k").alias(f"{p}k")).drop(f"{p}e")

    classes = prints.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("rows"))
    asked = queries.select("f0", "f1").distinct()
    left = spread(asked.select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), hexed("f0", "f1").alias("qfp")), "q")
    right = spread(classes.select("f0", "f1", "rows", hexed("f0", "f1").alias("cfp")), "c")
    earlier = F.lit(False)
    for t in range(len(tables)):
        earlier |= (F.col("qt") > t) & (key("qfp", t) == key("cfp", t))
    met = left.join(right, (F.col("qt") == F.col("ct")) & (F.col("qk") == F.col("ck"))
                    & (distance(("q0", "q1"), ("f0", "f1")) <= radius) & ~earlier)
    return met.groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg(F.sum("rows").alias("near"))


def next_rows(ids: DataFrame, order: list[Column], keys: list[str]) -> DataFrame:
    """Distinct ``ids`` with ``next``, the struct of ``keys`` of the row that follows in ``order``; the first row follows
    the last. Only ids are sorted, by ranges; one row per range is looked at to cross from range to range."""
    placed = materialize(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inner = Window.partitionBy("part").orderBy(*order)
    row = placed.withColumn("next", F.lead(F.struct(*keys)).over(inner)).withColumn("at", F.row_number().over(inner))
    firsts = row.where("at = 1").select("part", F.struct(*keys).alias("head"))
    over = Window.orderBy("part")  # a row per range
    heads = firsts.select("part", F.lead("head").over(over).alias("after"), F.first("head").over(
        over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"))
    return row.join(heads, "part").withColumn("next", F.coalesce("next", "after", "top")).drop("at", "after", "top", "part")


def fingerprint_documents(docs: DataFrame, radius: int = 3, query_step: int = 50) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_rows), a row per
    document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, by descending doc_id, nulls last, then by a hash of the text; after the last comes the first. Rows that
    repeat id and text stand once in that order and come out as often as they went in. A null text is empty; an empty
    text has a term of no words. ``near_rows`` counts the other rows within ``radius`` bits, for ids divisible by
    ``query_step``, else null. Other columns are not looked at.
    """
    keys = ["none", "id", "h"]
    text = text_of()
    own = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"),
                      F.xxhash64(text).alias("h"), text.alias("text"))
    order = [F.col("none"), F.desc("id"), F.desc("h")]
    ids = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).cast("long").alias("n_chars"))
    follows = materialize(next_rows(ids, order, keys))
    # Texts are shuffled once, by key, and met twice: as the next document and as the own one.
    wanted = follows.select(*[F.col(f"next.{k}").alias(f"n_{k}") for k in keys], *[F.col(k).alias(f"c_{k}") for k in keys],
                            F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    tails = own.join(wanted, [F.col(k) == F.col(f"n_{k}") for k in keys]).select(
        *[F.col(f"c_{k}") for k in keys], "half", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("tail"))
    both = own.join(tails, [F.col(k) == F.col(f"c_{k}") for k in keys]).select(
        *keys, "text", F.concat(F.expr("substring(text, 1, length(text) - half)"), "tail").alias("edited"))
    sides = both.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"),
                 F.sha2(F.col("edited").cast("binary"), 256).alias("sha")))).alias("s")) \
        .select(*keys, "s.side", "s.text", "s.sha")
    prints = materialize(fingerprint(sides, [*keys, "side", "sha"], F.col("text")))
    first = prints.where("side = 0").select(*keys, "f0", "f1")
    second = prints.where("side = 1").select(*keys, F.col("sha").alias("edited_sha256"), F.col("f0").alias("e0"),
                                             F.col("f1").alias("e1"))
    after = first.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.col("f0").alias("n0"), F.col("f1").alias("n1"))
    rows = follows.join(first, keys).join(second, keys).withColumns({f"n_{k}": F.col(f"next.{k}") for k in keys}) \
        .join(after, [f"n_{k}" for k in keys])
    every = follows.join(first, keys).select("none", "id", "f0", "f1", F.explode(
        F.expr("sequence(1L, copies)")).alias("copy"))
    near = near_counts(every, every.where(f"NOT none AND id % {query_step} = 0"), radius)
    asked = ~F.col("none") & (F.col("id") % query_step == 0)
    return rows.join(near, ["f0", "f1"], "left").select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        hexed("f0", "f1").alias("fingerprint"), hexed("e0", "e1").alias("edited_fingerprint"),
        likeness(("f0", "f1"), ("e0", "e1")).alias("near_edited"), likeness(("f0", "f1"), ("n0", "n1")).alias("near_next"),
        F.when(asked, F.col("near") - 1).alias("near_rows"), F.explode(F.expr("sequence(1L, copies)")).alias("copy")) \
        .drop("copy")
