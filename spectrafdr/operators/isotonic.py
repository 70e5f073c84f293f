"""Isotonic regression of 0/1 labels on a score, spread over range buckets.

The least-squares fit that never falls is a partition of the ordered scores into blocks, each
with its mean as rate; the cumulated blocks are the convex minorant of the cumulated labels.
Pooling neighbours that fall is right in any order and on any stretch, so:

1. distinct scores with their counts go to range buckets, and each bucket pools its own;
2. neighbouring buckets merge in pairs, then pairs of pairs, up a binary tree. Means rise
   within a side, so only blocks between the right side's lowest and the left side's highest
   mean can be pooled with one across the edge; only those go to the task of the edge,
   all others stay as they are;
3. block starts are carried on to the scores after them.

Nothing passes through the driver. A bucket holds at most ``scale.ROWS_PER_BUCKET`` scores. Blocks
have strictly rising fractions of whole numbers as means, which bounds their number by
O(rows^(2/3)) and thereby an edge's task; where rates rise with the score only few are
contested. Means are compared as products of whole numbers, so equal means always meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafdr.operators import scale

_BLOCK = "_side long, _start double, _n long, _good long"
# Rounds of whole-array pooling before the exact stack takes over.
_SWEEPS = 24


def pool(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """First places of the blocks of ascending points with ``n`` rows, ``good`` of them positive."""
    starts = np.arange(len(n))
    for _ in range(_SWEEPS):
        if len(starts) < 2:
            return starts
        weight, sums = np.add.reduceat(n, starts), np.add.reduceat(good, starts)
        rises = _less(sums[:-1], weight[:-1], sums[1:], weight[1:])
        if rises.all():
            return starts
        starts = starts[np.append(True, rises)]
    weight, sums = np.add.reduceat(n, starts).tolist(), np.add.reduceat(good, starts).tolist()
    stack: list[list[int]] = []
    for start, w, g in zip(starts.tolist(), weight, sums, strict=True):
        while stack and stack[-1][2] * w >= g * stack[-1][1]:
            start, before_w, before_g = stack.pop()
            w, g = w + before_w, g + before_g
        stack.append([start, w, g])
    return np.array([s[0] for s in stack])


def _less(good_a, n_a, good_b, n_b) -> np.ndarray:
    """Whether the first fraction is the smaller one, without rounding."""
    if max(int(n_a.max()), int(n_b.max())) < 1 << 31:
        return good_a * n_b < good_b * n_a
    return np.array([a * d < c * b for a, b, c, d in zip(good_a.tolist(), n_a.tolist(), good_b.tolist(), n_b.tolist(), strict=True)])


def _pooled(found: pa.Table) -> pa.Table:
    """Blocks of one side or edge, from points or blocks of it in any order."""
    found = found.sort_by("_start")
    n, good = found.column("_n").to_numpy(), found.column("_good").to_numpy()
    starts = pool(n, good)
    return pa.table(
        {
            "_side": found.column("_side").to_numpy()[starts],
            "_start": found.column("_start").to_numpy()[starts],
            "_n": np.add.reduceat(n, starts),
            "_good": np.add.reduceat(good, starts),
        }
    )


def blocks(bucketed: DataFrame, score: str, n: str, good: str, n_buckets: int) -> DataFrame:
    """``_start, _n, _good`` of the blocks; ``_bucket`` numbers the buckets in falling score order."""
    points = bucketed.select(
        F.col("_bucket").cast("long").alias("_side"), F.col(score).alias("_start"),
        F.col(n).cast("long").alias("_n"), F.col(good).cast("long").alias("_good"),
    )
    found = points.groupBy("_side").applyInArrow(_pooled, _BLOCK)
    sides = n_buckets
    while sides > 1:
        found = _merged(scale.materialise(found))
        sides = -(-sides // 2)
    return found.select("_start", "_n", "_good")


def _merged(found: DataFrame) -> DataFrame:
    """Sides 2k and 2k + 1 as side k; the odd one has the lower scores."""
    mean = F.col("_good") / F.col("_n")
    edge, left = F.floor(F.col("_side") / 2), F.col("_side") % 2 == 1
    # Means rise within a side: its first is the lowest, its last the highest. One row per edge.
    edges = found.groupBy(edge.alias("_edge")).agg(
        F.max(F.when(left, mean)).alias("_high"), F.min(F.when(~left, mean)).alias("_low")
    )
    placed = found.withColumn("_edge", edge).join(edges, "_edge")
    # Rounded means of the two ends may be equal or touch: those blocks count as contested.
    contested = F.coalesce((mean >= F.col("_low")) & (mean <= F.col("_high")), F.lit(False))
    columns = [F.col("_edge").alias("_side"), "_start", "_n", "_good"]
    quiet = placed.filter(~contested).select(*columns)
    pooled = placed.filter(contested).select(*columns).groupBy("_side").applyInArrow(_pooled, _BLOCK)
    return quiet.unionByName(pooled)


def fitted(counts: DataFrame, score: str, n: str, good: str, rate: str) -> DataFrame:
    """``counts`` (one row per distinct ``score``) with the fitted ``rate``."""
    rows = scale.materialise(counts.withColumn(score, F.col(score).cast("double")))
    n_rows = rows.count()
    order = [F.col(score).desc()]
    bucketed = scale.order_buckets(rows, order, n_rows)
    n_buckets = -(-n_rows // scale.ROWS_PER_BUCKET)
    starts = blocks(bucketed, score, n, good, n_buckets).select(
        F.col("_start").alias(score), (F.col("_good") / F.col("_n")).alias(rate)
    )
    marked = bucketed.join(starts, score, "left")
    return scale.carry_down(marked, F.col(score), [rate], n_rows).drop("_bucket")
