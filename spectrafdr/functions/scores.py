"""Score and tolerance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectrafdr.constants import PROBABILITY_FLOOR


def ranked(score: Column) -> Column:
    """TRUE for a score that has a place in an order: neither NULL nor NaN.

    Spark puts NaN above every number, so every filter, count and curve asks this first.
    """
    return score.isNotNull() & ~F.isnan(score.cast("double"))


def at_least(score: Column, cutoff: float) -> Column:
    """TRUE for a ranked score at or above ``cutoff``."""
    return ranked(score) & (score >= F.lit(cutoff))


def above(score: Column, cutoff: float) -> Column:
    """TRUE for a ranked score above ``cutoff``."""
    return ranked(score) & (score > F.lit(cutoff))


def probability_from_log(log_prob: Column) -> Column:
    return F.exp(log_prob)


def probability_from_penalised(score: Column) -> Column:
    """Scores below zero carry a mass-mismatch penalty of one; undo it and floor."""
    restored = F.when(score < 0, score + F.lit(1.0)).otherwise(score)
    return F.when(score.isNotNull(), F.greatest(restored, F.lit(PROBABILITY_FLOOR)))


def log_from_probability(probability: Column) -> Column:
    return F.when(
        probability.isNotNull(), F.log(F.greatest(probability, F.lit(PROBABILITY_FLOOR)))
    )


def log_from_penalised(score: Column) -> Column:
    return F.log(probability_from_penalised(score))


def token_logs(probabilities: Column) -> Column:
    return F.transform(probabilities, log_from_probability)


def posterior_error(score: Column) -> Column:
    """For a calibrated score the posterior error probability is its complement."""
    return F.lit(1.0) - score


def check_tolerance(tolerance: float, unit: str) -> str:
    """Validated, lower-case unit."""
    if isinstance(tolerance, bool) or not isinstance(tolerance, (int, float)):
        raise ValueError(f"tolerance {tolerance!r} is no number")
    if not isinstance(unit, str) or unit.strip().lower() not in ("ppm", "da"):
        raise ValueError(f"tolerance unit {unit!r} is neither 'ppm' nor 'da'")
    return unit.strip().lower()
