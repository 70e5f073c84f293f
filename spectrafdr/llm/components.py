"""Connected components by repeated contraction, on DataFrames only.

Every round maps each node to the smallest node next to it (a map-side combined minimum),
follows these pointers to their ends, rewrites the edges and drops the loops. Every end takes
in at least one other node, so rounds and joins grow with the logarithm of the nodes only. A path of images
stays a path, and the smallest node of a component always keeps itself, so when no edge is
left every node's label is the smallest node of its component. The joins have one row per
node on one side, so a node with a third of all edges is a skewed join that Spark splits.

Links are few beside what they were found in, and a round has many small exchanges: every
intermediate table is held in as many partitions as its rows need (``ROWS_PER_TASK``), so that
the files of an exchange do not outgrow its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafdr.operators import scale

ROWS_PER_TASK = 250_000
LEAST_TASKS = 8


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns ``u``, ``v``, any order, repeats allowed).

    Edges with a null end are ignored; loops only name their node; no edges give no rows.
    """
    given = scale.materialise(edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL"))
    tasks = max(LEAST_TASKS, -(-given.count() // ROWS_PER_TASK))

    def materialise(df: DataFrame) -> DataFrame:
        return scale.materialise(df.coalesce(tasks))

    given = given.coalesce(tasks)
    edges = materialise(_tidy(given))
    labels = given.select(F.col("u").alias("node")).union(given.select("v")).distinct()
    labels = materialise(labels.withColumn("label", F.col("node")))
    while not edges.isEmpty():
        ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = materialise(
            ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        )
        image = _roots(lowest.withColumnsRenamed({"u": "from", "m": "to"}), materialise)
        left = image.select(F.col("from").alias("u"), F.col("to").alias("_u"))
        right = image.select(F.col("from").alias("v"), F.col("to").alias("_v"))
        moved = edges.join(left, "u").join(right, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
        edges = materialise(_tidy(moved))
        labels = materialise(
            labels.join(image.select(F.col("from").alias("label"), "to"), "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")
            )
        )
    return labels


def _roots(image: DataFrame, materialise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Follow ``from -> to`` to the end: paths halve with every join, so few joins suffice."""
    while True:
        onward = image.select(F.col("from").alias("to"), F.col("to").alias("_next"))
        moved = materialise(image.join(onward, "to").select("from", F.col("_next").alias("to"), F.col("to").alias("_before")))
        image = moved.select("from", "to")
        if moved.filter("to <> _before").isEmpty():
            return image


def _tidy(edges: DataFrame) -> DataFrame:
    return (
        edges.filter("u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
