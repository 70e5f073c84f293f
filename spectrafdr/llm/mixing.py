"""Mixing sources to target weights by capped water-filling.

``source_targets``  one row per source: its size, weight and target
``mix``             every document with the number of words the mix takes from it
``mixed_documents`` the documents repeated (and one per source cut) as the mix takes them

Weights share the total size. A source stops at ``max_epochs`` times its own size; what it
cannot take goes to the others by weight, round by round, until none is above its limit.
Of each source every document is taken ``target div size`` whole times; the remaining
fraction is filled by documents in a seeded order (md5 of seed and id), whole ones first
and, exactly at the target, one document in part. So every source meets its target to the
word, and reruns agree.

The sampling needs a running sum inside a source. Documents fall into 4,096 slots by their
seeded key; slot totals give each slot's offset, and only the slot that holds the target is
ordered. A source with a third of all rows is thereby never ordered in one task.

Cases: null text has size 0 and is taken 0 times; a null source is a source of its own and
comes last; a null id sorts by its empty key; identical rows are interchangeable, rows that
share an id are ordered by size and text hash; an empty table gives an empty result; sources
of size 0 get target 0. Columns of the input other than id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrafdr.llm.common import packed, word_count
from spectrafdr.operators import scale

SLOTS_HEX = 3  # 16 ** 3 slots per source
SEED = "mix-1"
# Tables with a few numbers per source are broadcast up to this many counted sources.
BROADCAST_SOURCES = 100_000


def _key(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          seed: str = SEED) -> DataFrame:
    """Narrow rows ``doc_id, source, size, key, content`` for every document."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        word_count(text).alias("size"),
        _key(doc_id, seed).alias("key"),
        F.xxhash64(F.col(text)).alias("content"),
    )


def source_targets(measured: DataFrame, weights: tuple[float, ...] = (1, 2, 3),
                   max_epochs: float = 3) -> DataFrame:
    """``source, source_size, target`` for the sources of ``measured``.

    Sources in code-point order (null last) weigh ``weights`` in turn. Each round is one
    aggregate over the table of sources; a round that clamps nobody ends the loop, so there
    are at most as many rounds as clamped sources.
    """
    per_source = scale.materialise(
        measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    )
    n_sources = per_source.count()
    order = [F.col("source").asc_nulls_last()]
    placed = scale.running_totals(
        scale.order_buckets(per_source, order, n_sources), order, {"place": F.lit(1)}, n_sources
    )
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    )
    state = scale.materialise(
        placed.select(
            "source",
            "source_size",
            weight.alias("weight"),
            (F.col("source_size") * F.lit(float(max_epochs))).alias("limit"),
        )
    )
    clamped = F.lit(False)
    while True:
        total, taken, free = state.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(clamped, F.col("limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)),
        ).first()
        level = (total - taken) / free if free else 0.0
        share = F.lit(total - taken) * F.col("weight") / F.lit(free) if free else F.lit(0.0)
        above = clamped | (F.col("weight") * F.lit(level) > F.col("limit"))
        if state.filter(above & ~clamped).isEmpty():
            break
        clamped = above
    return state.select(
        "source", "source_size", F.when(clamped, F.col("limit")).otherwise(share).alias("target")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, key, content`` for every document."""
    measured = scale.store(sizes(docs, doc_id, text, source, seed))
    targets = source_targets(measured, weights, max_epochs)
    goals = scale.materialise(
        targets.withColumn("words", F.round("target").cast("long")).select(
            "source", "source_size", "target",
            F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0).alias("whole"),
            F.when(F.col("source_size") > 0, F.expr("words % source_size")).otherwise(0).alias("rest"),
        )
    )
    small = goals.count() <= BROADCAST_SOURCES
    slotted = measured.withColumn("slot", F.substring("key", 1, SLOTS_HEX))
    slots = slotted.groupBy("source", "slot").agg(F.sum("size").alias("in_slot"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.select(
        "source", "slot", "in_slot", F.coalesce(F.sum("in_slot").over(before), F.lit(0)).alias("offset")
    )
    # The slot of each source in which its fraction ends; all earlier slots are taken whole.
    last = (
        _join_source(offsets, goals.select("source", "rest"), small)
        .filter("offset <= rest AND rest < offset + in_slot")
        .select("source", F.col("slot").alias("last_slot"), F.col("offset").alias("last_offset"))
    )
    goals = scale.materialise(_join_source(goals, last, small, "left"))
    rows = _join_source(slotted, goals, small)
    inside = F.col("slot") == F.col("last_slot")
    early = F.col("slot") < F.col("last_slot")
    ordered = (
        Window.partitionBy("source", "slot")
        .orderBy("key", "doc_id", "size", "content")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    room = F.col("rest") - F.col("last_offset") - F.coalesce(F.sum("size").over(ordered), F.lit(0))
    cut = rows.filter(inside).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), room))
    )
    plain = rows.filter(F.coalesce(~inside, F.lit(True))).withColumn(
        "extra", F.when(early, F.col("size")).otherwise(F.lit(0))
    )
    return plain.unionByName(cut).select(
        "doc_id", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        "source", "key", "content",
    )


def _join_source(left: DataFrame, right: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Join on the null-safe source; ``right`` has at most one narrow row per source.

    ``small`` says that the sources were counted and are few enough to broadcast, so that rows
    of a large source stay where they are; otherwise Spark splits a skewed source.
    """
    other = right.withColumnRenamed("source", "_source")
    other = F.broadcast(other) if small else other
    return left.join(other, left["source"].eqNullSafe(other["_source"]), how).drop("_source")


def mixed_documents(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The input's rows as the mix takes them, in whole repetitions with their texts unchanged.

    ``docs`` has the columns of ``documents``; ``taken`` comes from :func:`mix` of the same
    rows. The one document per source that the mix takes in part is repeated once more if at
    least half of it is taken and not otherwise, so a source misses its target by at most
    half a document. Rows that share all of id, source and text become one row that is
    repeated as often as they were together. Other columns stay, whatever their names.
    """
    grouped = scale.materialise(
        taken.groupBy("doc_id", "source", "content")
        .agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"), F.count("*").alias("_rows"))
        .filter("_taken > 0")
        .withColumn("_times", F.expr("_taken div _size + if(2 * (_taken % _size) >= _size, 1, 0)"))
        .filter("_times > 0")
        .withColumnsRenamed({"doc_id": "_id", "source": "_source", "content": "_content"})
    )
    own = {"_doc": F.col("doc_id"), "_from": F.col("source").cast("string"), "_own": F.xxhash64("text")}
    joined = packed(docs, **own).join(
        grouped,
        F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_content")),
    )
    if not grouped.filter("_rows > 1").isEmpty():
        several = joined.filter("_rows > 1").dropDuplicates(["_id", "_source", "_content"])
        joined = joined.filter("_rows = 1").unionByName(several)
    copies = joined.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_copy"), "_row")
    return copies.select("_row.*")
