"""Stateless scoring of a stream with a fitted model and a fitted curve.

FDR fitting and q-values need the whole score distribution and stay batch. Features,
calibrated confidence, posterior error and the look-up in a STATIC curve act on one
row at a time, so they run unchanged on ``readStream``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrafdr.functions.scores import at_least, ranked
from spectrafdr.operators import scale
from spectrafdr.operators.calibrator import ProbabilityCalibrator
from spectrafdr.operators.fdr import FdrCurve, add_pep

# Entries of one node of the look-up tree: what a row carries at most while it is looked up.
FAN_OUT = 32


def steps(curve: FdrCurve) -> DataFrame:
    """``score, psm_fdr, rank``: the points at which the FDR changes, numbered from 0 by score.

    An as-of look-up gives the same in these points as in all of them. Stored.
    """
    n_rows, order = curve.n_points, [F.col("score").asc()]
    bucketed = scale.order_buckets(curve.points.select("score", "psm_fdr"), order, n_rows)
    before = F.lag("psm_fdr").over(Window.partitionBy("_bucket").orderBy(*order))
    if n_rows > scale.ROWS_PER_BUCKET:
        tops = bucketed.groupBy("_bucket").agg(F.max_by("psm_fdr", "score").alias("_top"))
        carried = tops.select("_bucket", F.lag("_top").over(Window.orderBy("_bucket")).alias("_carried"))
        bucketed = bucketed.join(F.broadcast(carried), "_bucket")  # one row per bucket
        before = F.coalesce(before, "_carried")
    changed = bucketed.withColumn("_before", before).filter(~F.col("psm_fdr").eqNullSafe(F.col("_before")))
    numbered = scale.running_totals(
        scale.materialise(changed.select("_bucket", "score", "psm_fdr")), order, {"rank": F.lit(1)}, n_rows
    )
    return scale.materialise(numbered.select("score", "psm_fdr", F.col("rank").cast("long").alias("rank")))


def _last_not_above(spark: SparkSession, scores: np.ndarray):
    """A column function: place of the last of the sorted ``scores`` not above a value, or NULL."""
    shared = spark.sparkContext.broadcast(scores)

    @F.pandas_udf("long")
    def look_up(values: pd.Series) -> pd.Series:
        at = np.searchsorted(shared.value, values.to_numpy(np.float64), side="right") - 1
        return pd.Series(at, dtype="Int64").where((at >= 0) & values.notna().to_numpy())

    return look_up


def _children(points: DataFrame, stride: int) -> DataFrame:
    """``_node, _children``: every ``stride``-th point, in nodes of ``FAN_OUT`` neighbours."""
    node = F.floor(F.col("rank") / (stride * FAN_OUT))
    return scale.materialise(
        points.filter(F.col("rank") % stride == 0).groupBy(node.alias("_node")).agg(
            F.array_sort(F.collect_list(F.struct("score", "psm_fdr"))).alias("_children")
        )
    )


def with_static_fdr(rows: DataFrame, score: str, curve: FdrCurve) -> DataFrame:
    """Add ``psm_fdr`` by a static curve of any size, to a table or a stream.

    That is the FDR of the highest fitted score not above a row's score, and 1.0 below the range.
    The curve is reduced to its steps first. Up to ``scale.BROADCAST_ROWS`` steps are sorted
    arrays in every task. More of them are a tree: the tasks hold every ``FAN_OUT**k``-th score,
    and a row goes down by k equi-joins with nodes of ``FAN_OUT`` entries, so what a row carries
    and what is broadcast is bounded whatever the size of the curve.
    """
    points = steps(curve)
    n_steps = points.count()
    levels = 0
    while -(-n_steps // FAN_OUT**levels) > scale.BROADCAST_ROWS:
        levels += 1
    tops = points.filter(F.col("rank") % FAN_OUT**levels == 0).select("score", "psm_fdr").toPandas().sort_values("score")
    placed = rows.withColumn("_score", F.col(score).cast("double"))
    placed = placed.withColumn("_node", _last_not_above(rows.sparkSession, tops["score"].to_numpy(np.float64))("_score"))
    if levels == 0:
        found = _entry(rows.sparkSession, tops["psm_fdr"].to_numpy(np.float64))("_node")
    for level in range(levels, 0, -1):
        joined = placed.join(_children(points, FAN_OUT ** (level - 1)), "_node", "left")
        at = F.size(F.filter("_children", lambda p: p["score"] <= F.col("_score"))) - 1
        if level > 1:
            following = F.when(F.col("_node").isNotNull(), F.col("_node") * FAN_OUT + at)
            placed = joined.withColumn("_node", following).drop("_children")
        else:
            placed, found = joined, F.get("_children", F.greatest(at, F.lit(0)))["psm_fdr"]
    inside = F.when(F.col("_node").isNotNull(), found).otherwise(F.lit(1.0))
    out = placed.withColumn("psm_fdr", F.when(ranked(F.col("_score")), inside))
    return out.drop("_node", "_score", "_children")


def _entry(spark: SparkSession, values: np.ndarray):
    """A column function: the entry of ``values`` at a place, NULL without one."""
    shared = spark.sparkContext.broadcast(values)

    @F.pandas_udf("double")
    def look_up(places: pd.Series) -> pd.Series:
        known = places.notna().to_numpy()
        at = places.fillna(0).to_numpy(np.int64)
        held = shared.value
        return pd.Series(held[at] if len(held) else np.zeros(len(at))).where(known)

    return look_up


def score_stream(
    rows: DataFrame,
    model: ProbabilityCalibrator,
    features,
    curve: FdrCurve,
    cutoff: float | None = None,
    score: str = "calibrated_confidence",
) -> DataFrame:
    """Features, calibrated confidence, ``psm_fdr`` and ``psm_pep``; kept at ``cutoff``."""
    scored = model.predict(features(rows), check_empty=False)
    out = add_pep(with_static_fdr(scored, score, curve), score)
    return out.filter(at_least(F.col(score), cutoff)) if cutoff is not None else out
