"""Mixing sources to target weights by Efraimidis-Spirakis keys, in DataFrame operations only.

Targets share the budget by weight; none passes ``most_epochs`` times its source's size, and what
is cut is shared again by weight (the water level has a closed form over sources sorted by the
level at which each fills). A source takes all its documents once for each whole epoch in its
target. The rest of the target takes documents in ascending order of ``-ln(u) / weight``, where u
is a hash of the document, up to the rest: a weighted sample without replacement. The document
that crosses the rest is taken if that comes nearer to it.

The order within a source is never sorted as a whole. Keys are mapped to slots by a monotone
function; sizes are summed by (source, slot) on the map side, the slot in which the rest is
crossed is found by a prefix sum over slots, and only that slot's keys are sorted, each with the
number of its rows. What remains is one cut a source, so each document decides on its own. Sources
are ranked and summed in ranges, so there may be many.

Null sources are one source, last in order; null and empty texts have size 0 and are taken in
whole epochs only, with nothing. Rows that repeat an id and a size, or a text without an id, share
a key; where the cut falls among them, as many are taken as come nearest to it. Weights that
are null or not positive count as 1. A very long text is a document as any other; an empty table
gives an empty one. Columns named ``size`` and the like may exist in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import NOT_WHITE
from granary.operators.rowid import with_row_id
from granary.session import stage

SLOTS = 16384
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
MOST_BROADCAST = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WHITE)), F.lit(0)).cast("bigint")


def document_name(doc_id: Column, text: Column, size: Column) -> Column:
    """What the hash is of: the id, or without one the text's digest, and the size."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))), size)


def sampling_key(name: Column, weight: Column) -> Column:
    """``-ln(u) / weight``, u from the first 52 bits of the name's MD5."""
    h = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return -F.log((h + 0.5) / float(1 << 52)) / F.when(weight > 0, weight).otherwise(1.0)


def _running(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Adds prefix sums of columns, this row included, in an order. Ranges of rows are summed on their
    own; the only window without a key has one row a range."""
    placed = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums])
    starts = totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(starts, F.col("_part") == F.col("_p"))
    return joined.select(*df.columns, *[(F.col(f"_{c}") + F.sum(c).over(inside)).alias(f"{c}_to") for c in sums])


def targets(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), most_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``."""
    ranked = with_row_id(sources.withColumn("none", F.col("source").isNull()), ["none", "source"], "at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod("at", F.lit(len(cycle))) + 1).cast("int"))
    weighed = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most_epochs)).withColumn("fills", F.col("cap") / F.col("w"))
    total = weighed.agg(F.sum(F.col("source_size").cast("double")).alias("size"), F.sum("w").alias("w")).first()
    summed = stage(_running(weighed, ["fills", "at"], ["cap", "w"]), "mix-fills")
    level = (F.lit(total["size"]) - (F.col("cap_to") - F.col("cap"))) / (F.lit(total["w"]) - (F.col("w_to") - F.col("w")))
    # Past the first source that isn't full, levels only fall, so the largest is that source's, also among equal ones.
    first_open = summed.agg(F.max(F.when(F.col("fills") >= level, level))).first()[0]
    target = F.col("cap") if first_open is None else F.least(F.col("cap"), F.col("w") * F.lit(first_open))
    return summed.select("source", "source_size", target.alias("target"))


def _keyed(docs: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Adds ``key`` and ``slot`` to what ``_sized`` gives."""
    if weights is None:
        weighed = docs.withColumn("weight", F.lit(1.0))
    else:
        weighed = docs.join(weights.select(F.col("doc_id").alias("_id"), "weight"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    keyed = weighed.withColumn("key", sampling_key(F.col("name"), F.coalesce("weight", F.lit(1.0)))).drop("weight", "name")
    return keyed.withColumn("slot", F.floor((1 - F.exp(-F.col("key"))) * (SLOTS - 1)).cast("int"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    size = words(F.col("text"))
    return docs.select("doc_id", "source", size.alias("size"), document_name(F.col("doc_id"), F.col("text"), size).alias("name"), *more)


def _planned(rows: DataFrame, keyed: DataFrame, cycle: tuple[float, ...], most_epochs: int) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``times``, how often a row is taken, to ``rows``, which have
    the columns of ``keyed``; ``keyed`` has all rows and decides where each source is cut."""
    by_slot = stage(keyed.groupBy("source", "slot").agg(F.sum("size").alias("slot_size")), "mix-slots")
    aims = stage(targets(by_slot.groupBy("source").agg(F.sum("slot_size").alias("source_size")), cycle, most_epochs), "mix-targets")
    small = aims.count() <= MOST_BROADCAST
    beside = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("bigint")
    aimed = aims.withColumn("epochs", F.least(epochs, F.lit(most_epochs))).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    aimed = aimed.withColumnRenamed("source", "aim")

    before = F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slot_size")
    crossing = by_slot.withColumn("before", before).join(beside(aimed.select("aim", F.col("rest").alias("left"))), same("source", "aim")).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("slot_size") > F.col("left")))
    crossing = crossing.select(F.col("source").alias("cross_source"), F.col("slot").alias("cross_slot"), "before", "left")

    inside = keyed.join(beside(crossing), same("source", "cross_source") & (F.col("slot") == F.col("cross_slot")))
    inside = inside.groupBy("source", "key", "size", "before", "left").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") * F.col("size")
    start = F.col("before") + F.sum(own).over(Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)) - own
    cut = inside.withColumn("start", start).where((F.col("start") <= F.col("left")) & (F.col("start") + own > F.col("left")))
    cut = cut.select(F.col("source").alias("cut_source"), F.struct("key", "size").alias("cut"), F.col("n").alias("cut_rows"), F.floor((F.col("left") - F.col("start")) / F.col("size") + 0.5).alias("cut_taken"))
    plan = stage(aimed.join(beside(cut), same("aim", "cut_source"), "left").drop("cut_source"), "mix-plan")

    at = F.struct("key", "size")
    drawn = F.when(F.col("cut").isNull(), F.col("rest") > 0).otherwise((at < F.col("cut")) | (at == F.col("cut")) & (F.col("cut_taken") == F.col("cut_rows")))
    times = F.col("epochs") + F.when(drawn & (F.col("size") > 0), 1).otherwise(0)
    planned = rows.join(beside(plan), same("source", "aim"), "left").withColumn("times", times.cast("int"))
    if plan.where("cut_taken > 0 AND cut_taken < cut_rows").isEmpty():
        return planned
    split = F.coalesce((at == F.col("cut")) & (F.col("cut_taken") > 0) & (F.col("cut_taken") < F.col("cut_rows")), F.lit(False))
    return planned.where(~split).unionByName(_shared_out(planned.where(split)))


def _shared_out(rows: DataFrame) -> DataFrame:
    """Rows that share their source's cut, of which the first ``cut_taken`` are taken once more. They
    are equal in what they weigh, so any will do; they are numbered in ranges, however many."""
    numbered = stage(with_row_id(rows.withColumn("tie", F.monotonically_increasing_id()), ["source", "tie"], "number"), "mix-cut")
    first = numbered.groupBy("source").agg(F.min("number").alias("first")).withColumnRenamed("source", "of")
    joined = numbered.join(first, F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("times", (F.col("times") + F.when(F.col("number") - F.col("first") < F.col("cut_taken"), 1).otherwise(0)).cast("int")).select(*rows.columns)


def mix(docs: DataFrame, weights: DataFrame | None = None, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), most_epochs: int = 3) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row a row of ``docs``.

    ``weights`` has ``(doc_id, weight)``, one row a document.
    """
    keyed = stage(_keyed(_sized(docs), weights), "mix")
    taken = (F.col("size") * F.col("times")).cast("bigint")
    return _planned(keyed, keyed, cycle, most_epochs).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights of labelled documents: 2 for good ones, 0.5 for bad ones."""
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.when(F.max("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), most_epochs: int = 3) -> DataFrame:
    """The mix itself: each row as many times as it is taken, with its own columns.

    Each row decides for itself, so ids may be null or repeated. Rows without words come once for
    each whole epoch of their source. Keys are computed twice, as texts aren't written for them.
    """
    keyed = stage(_keyed(_sized(docs), weights), "mix")
    rows = _keyed(_sized(docs, F.struct(*docs.columns).alias("row")), weights)
    planned = _planned(rows, keyed, cycle, most_epochs).where("times > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
