"""Mix sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis).

Every document draws u in (0, 1) from its id and gets the exponential key u^(1/weight); the largest keys go first. A
source with a target above its size is read in complete epochs first, and the keys choose the rest.

Only one number per source decides: the key at which the running size meets the budget. It is found from sums per
range of keys. The range where the budget ends is cut again between its own least and largest key, until few rows are
left, and only those are sorted: a source with a third of all rows is no sorted group, wherever its keys lie. Texts are never
moved: a row compares its own key with its source's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.draws import uniform
from hindcast.functions.scalars import quoted
from hindcast.llm.common import count_words, free_name, id_text, text_of
from hindcast.session import materialize

ROWS_PER_RANGE = 20_000  # sorted at most, unless they share a key
CUTS = 1000
MAX_EPOCHS = 2


def quality_weight(text: Column) -> Column:
    """0.1 to 1: how many words to a text's punctuation marks; clean prose is near 1, marked-up junk low."""
    odd = F.length(F.regexp_replace(text, r"[^#$%&*|!<>{}\[\]\\~^=+_]", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(8.0) * odd / F.greatest(F.length(text), F.lit(1)))


def weighted_key(seed: int, weight: Column, doc_id: str = "doc_id") -> Column:
    """u^(1/weight) with u from (seed, id) only, so that retries and reruns agree; u = 0 cannot occur."""
    u = uniform(seed, id_text(doc_id)) + F.lit(2.0**-53)
    return F.exp(F.log(u) / F.greatest(weight, F.lit(1e-6)))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a table with a row per source.

    Sources in order of code points, null last, take the weights in turn, and share ``share`` times all sizes. A target
    stops at MAX_EPOCHS times its source's size; the excess goes to the others by weight until none is above. In each
    round all sources above their limit are fixed at it; a source once fixed stays above with the larger share that
    the others then get, so the rounds end at the one solution. Sources are few by nature; ranks take one task.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    state = materialize(sizes.select(
        "source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"),
        F.lit(False).alias("full")))
    budget, limit, full = None, F.lit(float(MAX_EPOCHS)) * F.col("source_size"), None
    while True:
        row = state.agg(F.sum("source_size"), F.sum(F.when(F.col("full"), limit)),
                        F.sum(F.when(~F.col("full"), F.col("weight"))), F.count_if("full")).first()
        budget = share * (row[0] or 0) if budget is None else budget
        per_weight = max(0.0, budget - (row[1] or 0)) / row[2] if row[2] else 0.0
        if row[3] == full or not row[2]:
            break
        full = row[3]
        state = state.withColumn("full", F.col("full") | (F.col("weight") * per_weight > limit))
    target = F.when(F.col("full"), limit).otherwise(F.col("weight") * per_weight)
    return state.select("source", "source_size", target.cast("double").alias("target"))


def _end_of_budget(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, key, size, before, rest): per source the few keys among which the budget ends, with the sizes of those above."""
    own = plan.select(F.col("source").alias("p_source"), "rest")
    near = rows.join(own, F.expr("source <=> p_source")).select("source", "key", "size", "rest", F.lit(0.0).alias("before"))
    while True:
        spans = materialize(near.groupBy(F.col("source").alias("s_source")).agg(
            F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")))
        if not spans.where((F.col("n") > ROWS_PER_RANGE) & (F.col("lo") < F.col("hi"))).limit(1).count():
            return near
        place = F.least(F.floor((F.col("hi") - F.col("key")) / (F.col("hi") - F.col("lo")) * CUTS), F.lit(CUTS - 1))
        placed = near.join(spans, F.expr("source <=> s_source")) \
            .withColumn("range", F.when(F.col("hi") > F.col("lo"), place).otherwise(F.lit(0)))
        sums = placed.groupBy("source", "range").agg(F.sum("size").alias("total"), F.first("rest").alias("rest"),
                                                     F.first("before").alias("before"))
        upto = F.col("before") + F.sum("total").over(Window.partitionBy("source").orderBy("range"))
        ends = materialize(sums.withColumn("upto", upto).where("upto > rest AND upto - total <= rest").groupBy("source")
                           .agg(F.min_by(F.struct("range", (F.col("upto") - F.col("total")).alias("above")), "range").alias("end"))
                           .select(F.col("source").alias("e_source"), F.col("end.range").alias("e_range"), "end.above"))
        near = materialize(placed.join(ends, F.expr("source <=> e_source AND range = e_range"))
                           .select("source", "key", "size", "rest", F.col("above").alias("before")))


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, least): after the epochs, documents with a key of ``least`` or more."""
    plan = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(
        targets, F.expr("source <=> t_source"), "inner").select(
        F.col("source"), "source_size", "target",
        F.floor(F.try_divide("target", "source_size")).cast("long").alias("epochs")) \
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan)
    # Rows with one key, which are rows of one id, are taken together.
    close = _end_of_budget(rows, plan).groupBy("source", "key").agg(
        F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy(F.desc("key")))
    # The document in which the budget ends is taken if that comes nearer to the target.
    above = F.greatest(F.col("top") * (1 + 2.0**-52), F.col("top") + F.lit(5e-324))  # the next number after the largest key
    least = close.withColumn("upto", upto).withColumn("in", F.col("upto") - F.col("size") / 2.0 <= F.col("rest"))
    found = least.groupBy("source").agg(F.min(F.when(F.col("in"), F.col("key"))).alias("inside"),
                                        F.max("key").alias("top"), F.max("upto").alias("all")) \
        .select(F.col("source").alias("f_source"), "all", F.coalesce("inside", above).alias("least"))
    # Where all fits, all are taken; where nothing is left for them, none.
    least = F.when(F.coalesce(F.col("rest") > 0, F.lit(False)), F.when(F.col("all") > F.col("rest"), F.col("least"))
                   .otherwise(F.lit(-1.0))).otherwise(F.lit(2.0))
    return plan.join(found, F.expr("source <=> f_source"), "left").select(
        F.col("source").alias("t_source"), "source_size", "target", F.coalesce("epochs", F.lit(0)).alias("epochs"),
        least.alias("least"))


RESULT = ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_copies")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, seed: int = 7,
                weight: Column | None = None) -> DataFrame:
    """The documents' columns with (mix_size, mix_source_size, mix_target, mix_taken, mix_copies): words, words the
    mix takes, and how often it reads the document.

    Size: words of the text (null: 0). ``weight`` is the document's quality weight, by default from its marks. A null
    source is a source of its own, the last one; a null id draws as an empty one; rows of one id in one source share a
    draw and are taken or left together. Empty texts are taken zero words at a time. An empty table gives no rows. The names of
    the result must not be columns of ``docs``: that is an error. ``mixed`` takes any columns.
    """
    if clash := {c.lower() for c in docs.columns} & set(RESULT):
        raise ValueError(f"columns {sorted(clash)} are names of the result")
    return _mixed_by(docs, dict(zip(RESULT, RESULT)), weights, share, seed, weight)


def _mixed_by(docs: DataFrame, names: dict[str, str], weights: Sequence[int] = (5, 2, 1), share: float = 1.5, seed: int = 7,
              weight: Column | None = None) -> DataFrame:
    text = text_of("text")
    key = weighted_key(seed, quality_weight(text) if weight is None else weight)
    small = docs.select(F.col("source"), key.alias("key"), count_words(text).alias("size"))
    rows = materialize(small)  # a few bytes per document, read by several jobs
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share).withColumnRenamed("source", "t_source")
    limits = materialize(_thresholds(rows, targets))
    # Under names that the documents do not have.
    own = {c: free_name(f"_{c}", docs.columns) for c in limits.columns}
    limits = limits.select(*[F.col(c).alias(n) for c, n in own.items()])
    size = count_words(text)
    copies = F.col(own["epochs"]) + (key >= F.col(own["least"])).cast("long")
    found = {"mix_size": size, "mix_source_size": F.col(own["source_size"]), "mix_target": F.col(own["target"]),
             "mix_taken": size * copies, "mix_copies": copies}
    return docs.join(limits, F.col("source").eqNullSafe(F.col(own["t_source"])), "left").select(
        *[F.col(quoted(c)) for c in docs.columns], *[c.alias(names[n]) for n, c in found.items()])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the documents' columns, whatever their names: each document as often as the mix reads it."""
    names = {c: free_name(c, docs.columns) for c in RESULT}
    copies, copy = F.col(names["mix_copies"]), free_name("copy", docs.columns)
    rows = _mixed_by(docs, names, **options).where(copies > 0) \
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return rows.select(*[F.col(quoted(c)) for c in docs.columns])
