"""Curves and counts that describe a scored, labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafdr.functions.scores import ranked
from spectrafdr.operators import scale


def precision_recall(df: DataFrame, score: str, correct: str, tie: str) -> DataFrame:
    """Row-level running precision in descending score order.

    ``recall`` divides by the number of rows, not of positives. Ties are broken by
    ``tie``, which also lets the range partitioner split a hot score.
    """
    rows = df.select(
        F.col(tie).alias("tie"),
        F.col(score).cast("double").alias("score"),
        F.col(correct).cast("boolean").cast("int").alias("hit"),
    ).filter(ranked(F.col("score")))
    n = rows.count()
    order = [F.col("score").desc(), F.col("tie").asc()]
    placed = scale.running_totals(
        scale.order_buckets(rows, order, n),
        order,
        {"rank": F.lit(1), "hits": F.col("hit")},
        n,
        inclusive=True,
    )
    precision = F.col("hits") / F.col("rank")
    return placed.select(
        F.col("tie").alias(tie),
        F.col("score").alias(score),
        "rank",
        precision.alias("precision"),
        (F.col("hits") / F.lit(max(n, 1))).alias("recall"),
        (F.lit(1.0) - precision).alias("fdr"),
    )


def calibration_curve_width(df: DataFrame, score: str, correct: str, n_bins: int) -> DataFrame:
    """Equal-width, right-closed bins of [0, 1]; the lowest edge belongs to bin 1."""
    clipped = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    index = F.greatest(F.ceil(clipped * F.lit(n_bins)), F.lit(1)).cast("int")
    return (
        df.filter(ranked(F.col(score)))
        .select(
            index.alias("bin"), clipped.alias("s"), F.col(correct).cast("boolean").cast("int").alias("y")
        )
        .groupBy("bin")
        .agg(
            F.avg("s").alias("mean_score"),
            F.avg("y").alias("empirical_rate"),
            F.count("*").alias("n"),
        )
        .withColumn("centre", (F.col("bin") - F.lit(0.5)) / F.lit(float(n_bins)))
    )


def calibration_curve_frequency(
    df: DataFrame, score: str, correct: str, n_bins: int = 40
) -> DataFrame:
    """Equal-frequency bins over the ascending score order.

    Bin ``b`` covers positions ``floor(b*n/bins) .. floor((b+1)*n/bins) - 1``. Rows
    are first combined per (score, label): such a run covers a known position
    interval, so its share of every bin is arithmetic and no row-level sort is
    needed. Within a score, incorrect rows come first.
    """
    counts = scale.materialise(
        df.select(
            F.col(score).cast("double").alias("score"),
            F.col(correct).cast("boolean").cast("int").alias("y"),
        )
        .filter(ranked(F.col("score")) & F.col("y").isNotNull())
        .groupBy("score", "y")
        .agg(F.count("*").alias("n"))
    )
    size = counts.agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).first()
    groups, total = size["groups"], size["rows"] or 0
    order = [F.col("score").asc(), F.col("y").asc()]
    placed = scale.running_totals(
        scale.order_buckets(counts, order, groups), order, {"start": F.col("n")}, groups
    )

    def edge(k):
        return F.floor(k.cast("bigint") * F.lit(total) / F.lit(n_bins))

    def bin_of(position):
        return (F.ceil((position + 1) * F.lit(n_bins) / F.lit(max(total, 1))) - 1).cast("int")

    end = F.col("start") + F.col("n")
    spread = placed.select(
        "score", "y", "start", end.alias("end"),
        F.explode(F.sequence(bin_of(F.col("start")), bin_of(end - 1))).alias("bin"),
    )
    share = F.least("end", edge(F.col("bin") + 1)) - F.greatest("start", edge(F.col("bin")))
    return (
        spread.withColumn("w", share)
        .filter("w > 0")
        .groupBy("bin")
        .agg(
            (F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("mean_score"),
            (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("empirical_rate"),
            F.sum("w").alias("weight"),
        )
    )


def score_histogram(df: DataFrame, score: str, correct: str, n_bins: int = 100) -> DataFrame:
    """Rows per equal-width score bin of [0, 1] and label; 1.0 joins the last bin."""
    index = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    return (
        df.filter((F.col(score) >= 0) & (F.col(score) <= 1))
        .groupBy(index.alias("bin"), F.col(correct).alias("correct"))
        .agg(F.count("*").alias("n"))
    )


def classification_metrics(df: DataFrame, logit: str, label: str) -> DataFrame:
    """Mean logistic loss and accuracy at logit > 0, in the overflow-safe form."""
    z, y = F.col(logit), F.col(label).cast("double")
    loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - y * z
    return df.agg(
        F.avg(loss).alias("loss"),
        F.avg(((z > 0).cast("double") == y).cast("double")).alias("accuracy"),
    )
