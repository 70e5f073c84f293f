"""False discovery rate curves, look-ups, q-values and cut-offs.

All orderings act on one row per DISTINCT score. The counts per score come from
one map-side combined aggregation, so ties - even a score shared by a third of
the table - cost one row, and prefix sums run over bounded range buckets.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafdr.functions.scores import above, at_least, posterior_error, ranked
from spectrafdr.operators import scale
from spectrafdr.operators.filters import check_label_type, require_columns


@dataclass
class FdrCurve:
    """A fitted curve: one row per distinct fitted score.

    ``points``: ``score``, ``n`` (rows with that score), ``psm_fdr`` (value at the
    first position of the tie run), ``low_fdr`` (lowest value at any position of
    the run) and ``psm_q_value`` (lowest ``psm_fdr`` at this or a lower score).
    """

    points: DataFrame
    n_points: int
    low: float
    high: float
    lowest_fdr: float
    highest_fdr: float
    monotone: bool


def curve_from_points(points: DataFrame, n_points: int, monotone: bool = False) -> FdrCurve:
    """A curve from any method's ``score, n, psm_fdr, low_fdr`` rows, one per distinct score.

    Attaches q-values and reads the scalars the look-ups need. A custom FDR method only
    has to produce such rows; ``monotone`` states that FDR never falls with the score.
    ``n_points`` bounds the rows; ``points`` may carry the ``_bucket`` of
    ``scale.order_buckets`` in descending score order, else it is bucketed here.
    """
    if "_bucket" not in points.columns:
        points = scale.order_buckets(points, [F.col("score").desc()], n_points)
    points = scale.running_low(
        points, F.col("score"), F.col("psm_fdr"), "psm_q_value", n_points
    ).select("score", "n", "psm_fdr", "low_fdr", "psm_q_value")
    if n_points > scale.ROWS_PER_BUCKET:
        points = scale.materialise(points)  # otherwise one cheap window over a stored table
    bounds = points.agg(
        F.count("*").alias("n"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
        F.min("low_fdr").alias("lowest"),
        F.max("psm_fdr").alias("highest"),
    ).first()
    return FdrCurve(
        points, bounds["n"], bounds["low"], bounds["high"], bounds["lowest"], bounds["highest"],
        monotone,
    )


def fit_label_free(df: DataFrame, score: str) -> FdrCurve:
    """FDR of a score-ranked prefix as the mean of ``1 - score`` over the prefix.

    NULL and NaN scores have no rank and are left out.
    """
    counts = scale.materialise(
        df.select(F.col(score).cast("double").alias("score"))
        .filter(ranked(F.col("score")))
        .groupBy("score")
        .agg(F.count("*").alias("n"))
    )
    n_points = counts.count()
    if n_points == 0:
        raise ValueError("no row has a score to fit a curve on")
    order = [F.col("score").desc()]
    error = F.lit(1.0) - F.col("score")
    placed = scale.running_totals(
        scale.order_buckets(counts, order, n_points),
        order,
        {"_above": F.col("n"), "_err": F.col("n") * error},
        n_points,
    )
    value = (F.col("_err") + error) / (F.col("_above") + F.lit(1))
    points = placed.withColumns({"psm_fdr": value, "low_fdr": value})
    return curve_from_points(points, n_points, monotone=True)


def fit_label_based(
    df: DataFrame,
    score: str,
    correct: str = "correct",
    drop: int = 10,
    validity: str = "valid_sequence",
) -> FdrCurve:
    """FDR of a score-ranked prefix as its share of incorrect rows.

    The column ``correct`` uses rows with a valid label only; any other label
    column (a proxy such as a database hit) uses every row. Rows of equal score
    are ranked incorrect-first, the conservative order: it makes the curve a
    function of per-score counts and independent of row order. The first ``drop``
    positions do not enter the curve.
    """
    sequence_labels = correct == "correct"
    require_columns(df, [score, correct] + ([validity] if sequence_labels else []))
    check_label_type(df, correct)
    rows = df
    if sequence_labels:
        rows = rows.filter(F.coalesce(F.col(validity), F.lit(False)))
    counts = scale.materialise(
        rows.select(
            F.col(score).cast("double").alias("score"),
            F.col(correct).cast("boolean").cast("int").alias("hit"),
        )
        .filter(ranked(F.col("score")))
        .groupBy("score")
        .agg(
            F.count("*").alias("n"),
            F.sum("hit").alias("good"),
            F.count_if(F.col("hit").isNull()).alias("unlabelled"),
        )
    )
    size = counts.agg(
        F.count("*").alias("points"), F.sum("n").alias("rows"), F.sum("unlabelled").alias("nulls")
    ).first()
    if size["points"] == 0:
        raise ValueError("Fit method requires at least one labelled row")
    if size["nulls"]:
        raise ValueError(f"label {correct!r} is NULL in some row")
    if size["rows"] <= drop:
        raise ValueError(
            f"{size['rows']} labelled rows, but the first {drop} positions are dropped"
        )
    n_points = size["points"]
    order = [F.col("score").desc()]
    placed = scale.running_totals(
        scale.order_buckets(counts, order, n_points),
        order,
        {"_above": F.col("n"), "_hits": F.col("good")},
        n_points,
    )
    first = F.greatest(F.col("_above"), F.lit(drop))  # 0-based position of the first kept row
    bad_in_run = F.col("n") - F.col("good")
    hits_at_first = F.col("_hits") + F.greatest(
        F.lit(0), first - F.col("_above") + F.lit(1) - bad_in_run
    )
    at_first = F.lit(1.0) - hits_at_first / (first + 1)
    at_last = F.lit(1.0) - (F.col("_hits") + F.col("good")) / (F.col("_above") + F.col("n"))
    points = placed.filter(F.col("_above") + F.col("n") > F.lit(drop)).withColumns(
        {"psm_fdr": at_first, "low_fdr": F.least(at_first, at_last)}
    )
    return curve_from_points(points, n_points, monotone=False)


def confidence_cutoff(curve: FdrCurve, threshold: float) -> float | None:
    """Score at the last curve position whose FDR is at most ``threshold``.

    ``None`` when no position qualifies.
    """
    cutoff = (
        curve.points.filter(F.col("low_fdr") <= F.lit(threshold)).agg(F.min("score")).first()[0]
    )
    if cutoff is None:
        warnings.warn(
            f"FDR threshold {threshold} is below the fitted range (min {curve.lowest_fdr:.4f}); "
            "no score qualifies",
            stacklevel=2,
        )
    elif threshold > curve.highest_fdr:
        warnings.warn(
            f"FDR threshold {threshold} is above the fitted range (max {curve.highest_fdr:.4f}); "
            f"returning the lowest fitted score {cutoff:.4f}",
            stacklevel=2,
        )
    return cutoff


def confidence_curve(
    curve: FdrCurve, resolution: float, min_fdr: float, max_fdr: float
) -> DataFrame:
    """Cut-off score for every threshold of an evenly spaced grid.

    Each curve point is assigned to the first threshold it satisfies, the lowest
    score per threshold is aggregated, and a running minimum over the (small)
    grid carries it to all looser thresholds: one pass over the curve whatever
    the grid size.
    """
    import numpy as np

    grid = [float(t) for t in np.arange(min_fdr, max_fdr, resolution)]
    return cutoffs_at(curve, grid)


def cutoffs_at(curve: FdrCurve, thresholds: list[float]) -> DataFrame:
    """``threshold, cutoff`` (NULL cut-off when no score qualifies)."""
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import Window

    spark = curve.points.sparkSession
    grid = sorted(set(thresholds))
    frame = spark.createDataFrame(
        [(i, t) for i, t in enumerate(grid)], "slot int, threshold double"
    )
    # Bucketizer is left-closed, thresholds are right-closed: negate both sides.
    edges = [float("-inf"), *[-t for t in reversed(grid)], float("inf")]
    placed = Bucketizer(splits=edges, inputCol="_neg", outputCol="_edge").transform(
        curve.points.select("score", (-F.col("low_fdr")).alias("_neg"))
    )
    slots = (
        placed.select("score", (F.lit(len(grid)) - F.col("_edge")).cast("int").alias("slot"))
        .filter(F.col("slot") < len(grid))
        .groupBy("slot")
        .agg(F.min("score").alias("score"))
    )
    upto = Window.orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    return frame.join(F.broadcast(slots), "slot", "left").select(
        "threshold", F.min("score").over(upto).alias("cutoff")
    )


def yield_at(df: DataFrame, score: str, cutoffs: DataFrame) -> DataFrame:
    """Rows with ``score >= cutoff`` per threshold (0 when there is no cut-off)."""
    targets = [(r["threshold"], r["cutoff"]) for r in cutoffs.collect()]  # one row per target
    counts = df.agg(
        *[
            (F.count_if(at_least(F.col(score), c)) if c is not None else F.lit(0).cast("bigint")).alias(
                f"n{i}"
            )
            for i, (_, c) in enumerate(targets)
        ]
    )
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(t).alias("threshold"),
                        F.lit(c).cast("double").alias("cutoff"),
                        F.col(f"n{i}").alias("n_psms"),
                    )
                    for i, (t, c) in enumerate(targets)
                ]
            )
        ).alias("s")
    ).select("s.*")


def score_table(df: DataFrame, score: str, curve: FdrCurve) -> tuple[DataFrame, int]:
    """As-of look-up of every distinct score of ``df`` in a curve fitted elsewhere.

    A score takes the FDR of the highest fitted score that is not above it, and
    1.0 below the fitted range; its q-value is the running minimum of that FDR
    over the scores of ``df``. Distinct scores and curve points are merged and
    filled in range buckets, so no row table is sorted and no side is collected.
    """
    probe = (
        df.select(F.col(score).cast("double").alias("score"))
        .filter(ranked(F.col("score")))
        .groupBy("score")
        .agg(F.count("*").alias("n"))
    )
    merged = scale.materialise(
        probe.withColumn("psm_fdr", F.lit(None).cast("double"))
        .unionByName(curve.points.select("score", F.lit(0).cast("bigint").alias("n"), "psm_fdr"))
        .groupBy("score")
        .agg(F.sum("n").alias("n"), F.max("psm_fdr").alias("psm_fdr"))
    )
    n_rows = merged.count()
    order = [F.col("score").desc()]
    filled = scale.carry_down(
        scale.order_buckets(merged, order, n_rows), F.col("score"), ["psm_fdr"], n_rows
    )
    own = filled.filter(F.col("n") > 0).withColumn(
        "psm_fdr", F.coalesce("psm_fdr", F.lit(1.0))
    )
    table = scale.running_low(
        own, F.col("score"), F.col("psm_fdr"), "psm_q_value", n_rows
    ).select("score", "n", "psm_fdr", "psm_q_value")
    return table, n_rows


def annotate(
    df: DataFrame,
    score: str,
    curve: FdrCurve,
    same_scores: bool = False,
    salt_on: list[str] | None = None,
) -> DataFrame:
    """Add ``psm_fdr`` and ``psm_q_value``.

    ``same_scores`` promises that the curve was fitted label-free on exactly these
    scores: the look-up is then a plain equi-join on the score.
    """
    if same_scores and curve.monotone:
        table = curve.points.select("score", "n", "psm_fdr", "psm_q_value")
        n_rows = curve.n_points
    else:
        table, n_rows = score_table(df, score, curve)
    keyed = df.withColumn("_score", F.col(score).cast("double"))
    return scale.lookup_join(
        keyed,
        table.withColumnRenamed("score", "_score"),
        "_score",
        n_rows,
        weight="n",
        salt_on=salt_on,
    ).drop("_score")


def add_pep(df: DataFrame, score: str) -> DataFrame:
    return df.withColumn("psm_pep", posterior_error(F.col(score)))


def filter_above(df: DataFrame, score: str, cutoff: float | None) -> DataFrame:
    """Library filter: scores strictly above the cut-off; nothing without one."""
    return df.filter(above(F.col(score), cutoff)) if cutoff is not None else df.limit(0)


def filter_at(
    df: DataFrame, score: str, cutoff: float | None, keep_all_without_cutoff: bool = False
) -> DataFrame:
    """Pipeline filter: scores at or above the cut-off."""
    if cutoff is None:
        return df if keep_all_without_cutoff else df.limit(0)
    return df.filter(at_least(F.col(score), cutoff))


def control_fdr(
    df: DataFrame,
    score: str,
    threshold: float,
    curve: FdrCurve,
    same_scores: bool = False,
    pep: bool = True,
    keep_all_without_cutoff: bool = False,
) -> DataFrame:
    """Annotate every row, then keep those at or above the cut-off.

    The cut-off filter is applied before the look-up join - the annotations of the
    kept rows do not depend on the dropped ones once the curve exists - unless the
    q-value has to be taken over all rows of a foreign data set.
    """
    cutoff = confidence_cutoff(curve, threshold)
    if same_scores and curve.monotone:
        kept = filter_at(df, score, cutoff, keep_all_without_cutoff)
        out = annotate(kept, score, curve, same_scores=True)
    else:
        out = filter_at(annotate(df, score, curve), score, cutoff, keep_all_without_cutoff)
    return add_pep(out, score) if pep else out
