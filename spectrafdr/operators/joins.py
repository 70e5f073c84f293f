"""Key checks and the joins that assemble PSM rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrafdr.operators import scale
from spectrafdr.operators.filters import require_columns


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts (map-side combined)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def orphan_keys(predictions: DataFrame, spectra: DataFrame, key: str) -> DataFrame:
    """Distinct prediction keys without a spectrum."""
    wanted = predictions.select(key).distinct()
    return wanted.join(spectra.select(key), key, "left_anti")


def first_offenders(df: DataFrame, key: str, count: int = 5) -> DataFrame:
    """The smallest ``count`` keys, for a message."""
    return df.select(key).orderBy(key).limit(count)


def _first_values(df: DataFrame, key: str) -> list:
    return [r[0] for r in first_offenders(df, key).collect()]


def check_unique(df: DataFrame, key: str, what: str) -> None:
    _reject_repeated(duplicate_keys(df, key), key, what)


def _reject_repeated(repeated: DataFrame, key: str, what: str) -> None:
    bad = _first_values(repeated, key)
    if bad:
        raise ValueError(f"{what} {key!r} values must be unique; duplicates: {bad}")


def check_no_orphans(predictions: DataFrame, spectra: DataFrame, key: str) -> None:
    _reject_orphans(orphan_keys(predictions, spectra, key), key)


def _reject_orphans(orphans: DataFrame, key: str) -> None:
    bad = _first_values(orphans, key)
    if bad:
        raise ValueError(f"no spectrum for {key} of these predictions: {bad}")


def join_spectra(
    predictions: DataFrame,
    spectra: DataFrame,
    key: str = "spectrum_id",
    unique_predictions: bool = False,
    known_unique: tuple[str, ...] = (),
) -> DataFrame:
    """Inner join of predictions to spectra.

    Spectrum keys are unique; every prediction needs a spectrum, spectra without a
    prediction are dropped. Columns that exist on both sides come from the spectra.
    Predictions of one key may be numerous. One narrow, map-side combined pass counts the keys
    of both sides into a stored table, which answers all checks and steers the salting of
    hot keys. ``known_unique`` names sides (``spectra``, ``predictions``) whose keys are
    unique by construction.
    """
    for frame in (predictions, spectra):
        require_columns(frame, [key])
    sides = predictions.select(key, F.lit(1).alias("_p"), F.lit(0).alias("_s")).union(
        spectra.select(key, F.lit(0), F.lit(1))
    )
    counts = scale.materialise(sides.groupBy(key).agg(F.sum("_p").alias("_w"), F.sum("_s").alias("_s")))
    if "spectra" not in known_unique:
        _reject_repeated(counts.filter("_s > 1"), key, "spectrum")
    if unique_predictions and "predictions" not in known_unique:
        _reject_repeated(counts.filter("_w > 1"), key, "prediction")
    _reject_orphans(counts.filter((F.col("_w") > 0) & ((F.col("_s") == 0) | F.col(key).isNull())), key)
    clash = [c for c in predictions.columns if c in spectra.columns and c != key]
    predictions = predictions.drop(*clash)
    if unique_predictions:
        return predictions.join(spectra, key, "inner")
    return scale.shuffle_join(predictions, spectra, key, "inner", counts=counts)


def top_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row per key in ``order`` (ascending struct order).

    ``min_by`` keeps one row per key on the map side, so a key with a third of the
    rows costs one buffer per task; a window would sort them all in one.
    """
    rest = [c for c in df.columns if c != key]
    rank = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])
    best = F.min_by(F.struct(*rest), rank)
    return df.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")


def candidates_per_key(
    df: DataFrame, key: str, rank: list[Column], payload: list[Column], name: str
) -> DataFrame:
    """All rows of a key as one array ordered by ``rank`` (ascending struct order)."""
    entry = F.struct(
        *[r.alias(f"k{i}") for i, r in enumerate(rank)], F.struct(*payload).alias("entry")
    )
    return df.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias(name)
    )


def top_k_per_key(df: DataFrame, key: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key with their ``rank`` from 1.

    Spark limits the groups of a ranking filter before the shuffle, so a key sends at most
    ``k`` rows per task however many it has.
    """
    best = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(best)).filter(F.col(rank) <= k)


def candidate_chunks(
    df: DataFrame, key: str, order: list[str], payload: list[str], name: str, size: int = 10_000
) -> DataFrame:
    """``key, chunk, name``: all rows of a key in order, as numbered lists of at most ``size``.

    ``order`` are columns that tell the rows of a key apart, ascending. Rows are ordered by
    (key, order) in range buckets and counted on, so a key with a third of all rows is
    ordered by many tasks and no list grows with the key.
    """
    rows = scale.materialise(df.select(key, *dict.fromkeys([*order, *payload])))
    n_rows = rows.count()
    keys = [F.col(c).asc() for c in (key, *order)]
    placed = scale.running_totals(
        scale.order_buckets(rows, keys, n_rows), keys[1:], {"_place": F.lit(1)}, n_rows, within=[key]
    )
    entry = F.struct("_place", F.struct(*payload).alias("entry"))
    chunk = F.floor(F.col("_place") / size).cast("long").alias("chunk")
    return placed.groupBy(key, chunk).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias(name)
    )


def band_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str,
    tolerance: float, unit: str = "da",
) -> DataFrame:
    """Inner join on ``keys`` and ``|left_value - right_value| <= tolerance``.

    Values fall into bins as wide as the tolerance; the right side is repeated in the two
    neighbouring bins, so partners always share one and meet there only. ``ppm`` is relative
    to the right value and takes bins of its logarithm. Hot bins are measured and salted.
    Values that are NULL, NaN or, for ``ppm``, not positive have no partner.
    """
    if tolerance <= 0 or unit not in ("da", "ppm"):
        raise ValueError(f"a band join needs a positive tolerance in da or ppm, got {tolerance} {unit}")
    def usable(column: str) -> Column:
        value = F.col(column)
        sound = value.isNotNull() & ~F.isnan(value.cast("double"))
        return sound & (value > 0) if unit == "ppm" else sound

    # A relative difference of t is at most -log(1 - t) in the logarithm. A little wider, so that
    # rounding puts no pair two bins apart.
    width = (tolerance if unit == "da" else -math.log1p(-tolerance * 1e-6)) * (1 + 1e-9)

    def bin_of(column: str) -> Column:
        value = F.col(column).cast("double")
        return F.floor(F.log(value) / F.lit(width) if unit == "ppm" else value / F.lit(width))

    near = F.array(*[bin_of(right_value) + i for i in (-1, 0, 1)])
    ours = left.filter(usable(left_value)).withColumn("_bin", F.struct(*keys, bin_of(left_value).alias("_b")))
    theirs = right.filter(usable(right_value)).withColumn("_b", F.explode(near))
    theirs = theirs.withColumn("_bin", F.struct(*keys, "_b")).drop("_b", *keys)
    apart = F.abs(F.col(left_value) - F.col(right_value))
    limit = F.lit(tolerance) if unit == "da" else F.col(right_value) * F.lit(tolerance) / F.lit(1e6)
    return scale.shuffle_join(ours, theirs, "_bin", "inner").filter(apart <= limit).drop("_bin")
