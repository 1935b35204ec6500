"""Exact duplicates by deterministic block naming.

Normalised texts are cut into blocks of a fixed number of bytes. Equal blocks get equal integer names: the place of the
block among the sorted distinct blocks of its partition, with the partition's number above it. Then names of adjacent
blocks are paired and the pairs named in the same way, level by level, until each document has one name. Names are
places in a sorted list, not hashes, so two texts have the same (level, name) only if they are equal.

Only distinct blocks travel as text, combined on the map side, so a block that a third of all documents share is one row
per task. Rows carry a 64-bit hash to their name; where two blocks share a hash the join is on the block itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalars import quoted
from hindcast.llm.common import free_name, lower_ascii, numbered, text_of
from hindcast.session import materialize

BLOCK_BYTES = 4096


def _blocks(data: Column, size: int) -> Column:
    count = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _named(keys: DataFrame) -> DataFrame:
    """Distinct rows with ``name``: their place in their sorted partition. A lost partition is named alike again."""
    distinct = keys.distinct()
    return distinct.sortWithinPartitions(*distinct.columns).withColumn("name", F.monotonically_increasing_id())


def name_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, text_sha256, level, name), a row per document: equal texts have equal (level, name).

    ``docs`` holds ``row``, a written number of each row's own.
    """
    data = lower_ascii(text_of()).cast("binary")
    parts = docs.select("row", "doc_id", data.alias("data")) \
        .select("row", "doc_id", F.sha2("data", 256).alias("text_sha256"),
                F.posexplode(_blocks(F.col("data"), block_bytes)).alias("pos", "block"))
    # Where a row's blocks stand: small.
    at = materialize(parts.select("row", "doc_id", F.when(F.col("pos") == 0, F.col("text_sha256")).alias("text_sha256"),
                                  "pos", F.xxhash64("block").alias("hash")))
    blocks = docs.select(F.explode(_blocks(data, block_bytes)).alias("block"))
    names = materialize(_named(blocks).select(F.xxhash64("block").alias("hash"), "name"))
    shared = names.groupBy("hash").count().where("count > 1").select("hash")
    if shared.limit(1).count():
        by_hash = materialize(names.groupBy("hash").agg(F.min("name").alias("name")))
        placed = _settle(docs, data, block_bytes, at.join(by_hash, "hash", "left"), shared)
    else:
        # Two written tables: where many rows share a block, Spark splits that part of the join.
        placed = at.join(names, "hash", "left")
    level = materialize(placed.select("row", "doc_id", "text_sha256", "pos", "name"))
    done, depth = [], 0
    lengths = level.groupBy("row").agg(F.max("pos").alias("last"))
    longest = lengths.agg(F.max("last")).first()[0] or 0
    heads = level.where("pos = 0").select("row", "doc_id", "text_sha256")
    multi = level.join(lengths.where("last > 0").select("row", "last"), "row", "left")
    done.append(multi.where("last IS NULL").select("row", F.lit(0).alias("level"), "name"))
    if longest:
        level = materialize(multi.where("last IS NOT NULL").select("row", "pos", "last", "name"))
    while longest:
        depth += 1
        pairs = level.groupBy("row", F.floor(F.col("pos") / 2).alias("pos"), F.floor(F.col("last") / 2).alias("last")) \
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                 F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right")) \
            .withColumn("right", F.coalesce("right", F.lit(-1)))
        level = materialize(pairs.join(_named(pairs.select("left", "right")), ["left", "right"])
                            .select("row", "pos", "last", "name"))
        done.append(level.where("last = 0").select("row", F.lit(depth).alias("level"), "name"))
        level = level.where("last > 0")
        longest //= 2
    names = done[0]
    for part in done[1:]:
        names = names.unionByName(part)
    return heads.join(names, "row")


def _settle(docs: DataFrame, data: Column, size: int, placed: DataFrame, shared: DataFrame) -> DataFrame:
    """Names of their own, below -1, for blocks whose hash other blocks share too, met by the blocks themselves."""
    own = docs.select("row", data.alias("data")) \
        .select("row", F.posexplode(_blocks(F.col("data"), size)).alias("pos", "block")) \
        .join(shared, F.xxhash64("block") == F.col("hash"), "left_semi")
    names = materialize(_named(own.select("block")))
    settled = own.join(names, "block").select("row", "pos", (F.lit(-2) - F.col("name")).alias("settled"))
    return placed.join(settled, ["row", "pos"], "left").withColumn("name", F.coalesce("settled", "name"))


def find_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256), a row per document, dropped ones too.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one, and empty texts are equal. Of
    equal texts the row with the largest doc_id stays; a null id is smaller than any other, and of rows with one id the
    last in the table stays. ``keep_id`` is null where only rows without id share the text. Other columns are not looked
    at. A text of any length is blocks, of which a row holds one at a time. An empty table gives no rows. ``row`` is the
    row's number in the copy of the table that the work reads.
    """
    return _duplicates(numbered(docs.select("doc_id", "text")), block_bytes)


def _duplicates(docs: DataFrame, block_bytes: int) -> DataFrame:
    named = materialize(name_texts(docs, block_bytes))
    # Only texts that occur twice or more are met with their rows, and as a written table, so that Spark can split the join.
    best = materialize(named.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    alone = F.col("best").isNull()
    return named.join(best, ["level", "name"], "left").select(
        "row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that ``find_duplicates`` keeps, with all their columns."""
    row = free_name("row", docs.columns)
    rows = numbered(docs, row)
    dropped = _duplicates(rows.select(F.col(row).alias("row"), "doc_id", "text"), block_bytes).where("NOT kept") \
        .select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti") \
        .select(*[F.col(quoted(c)) for c in docs.columns])
