"""Observed-versus-predicted spectrum comparison.

The greedy one-to-one peak assignment depends on the peaks taken so far, so it
cannot be a relational join; it runs per row inside ONE Arrow UDF that returns all
nine features. Spectra stay arrays in their row: nothing is exploded or shuffled.
The array statistics that need no such state are column expressions below.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafdr.constants import (
    CARBON_ISOTOPE_MASS_SHIFT,
    XCORR_BIN_OFFSET,
    XCORR_BIN_SIZE,
    XCORR_MAX_OFFSET,
    XCORR_NUM_WINDOWS,
    XCORR_WINDOW_NORM_VALUE,
)
from spectrafdr.functions.scores import check_tolerance

ION_FEATURES: tuple[str, ...] = (
    "ion_matches",
    "ion_match_intensity",
    "longest_b_series",
    "longest_y_series",
    "complementary_ion_count",
    "max_ion_gap",
    "b_y_intensity_ratio",
    "spectral_angle",
    "xcorr",
)
_INTEGER_FEATURES = ("longest_b_series", "longest_y_series", "complementary_ion_count")

MATCH_TYPE = T.StructType(
    [
        T.StructField("match_rate", T.DoubleType()),
        T.StructField("match_intensity", T.DoubleType()),
        T.StructField("annotations", T.ArrayType(T.StringType())),
        T.StructField("mz", T.ArrayType(T.DoubleType())),
        T.StructField("intensities", T.ArrayType(T.DoubleType())),
        T.StructField("aligned", T.ArrayType(T.DoubleType())),
    ]
)

_ISOTOPES = np.arange(5)


# --- per-row numpy kernels --------------------------------------------------


def match_peaks(ion_mz, ion_charge, peak_mz, peak_intensity, tolerance, unit):
    """Greedy assignment in ion order: (matched mask, own peak, envelope sum).

    Each ion takes the nearest free peak strictly within tolerance (the left one
    on a tie); a matched ion then claims free peaks at the M+1..M+4 spacings.
    All insertion points are found in one vectorised search; the loop only walks
    past peaks that are already taken.
    """
    n, m = len(ion_mz), len(peak_mz)
    matched = np.zeros(n, dtype=bool)
    own = np.zeros(n)
    envelope = np.zeros(n)
    if n == 0 or m == 0:
        return matched, own, envelope
    targets = ion_mz[:, None] + _ISOTOPES * (CARBON_ISOTOPE_MASS_SHIFT / ion_charge)[:, None]
    widths = np.full(targets.shape, tolerance) if unit == "da" else targets * tolerance / 1e6
    entry = np.searchsorted(peak_mz, targets, side="left")
    lo = np.searchsorted(peak_mz, targets - widths, side="left") - 1
    hi = np.searchsorted(peak_mz, targets + widths, side="right") + 1
    free = np.ones(m, dtype=bool)

    def claim(i, k):
        target, width = targets[i, k], widths[i, k]
        left, right = entry[i, k] - 1, entry[i, k]
        floor, ceiling = max(lo[i, k], 0), min(hi[i, k], m)
        while left >= floor and not free[left]:
            left -= 1
        while right < ceiling and not free[right]:
            right += 1
        d_left = abs(peak_mz[left] - target) if left >= floor else np.inf
        d_right = abs(peak_mz[right] - target) if right < ceiling else np.inf
        best, distance = (left, d_left) if d_left <= d_right else (right, d_right)
        if distance >= width:
            return -1
        free[best] = False
        return best

    for i in range(n):
        peak = claim(i, 0)
        if peak < 0:
            continue
        matched[i] = True
        own[i] = peak_intensity[peak]
        envelope[i] = own[i]
        for k in range(1, 5):
            isotope = claim(i, k)
            if isotope >= 0:
                envelope[i] += peak_intensity[isotope]
    return matched, own, envelope


def _ion_index(annotations, kind):
    """Fragment numbers of one series; -1 where the annotation is another series."""
    out = np.full(len(annotations), -1, dtype=np.int64)
    for i, text in enumerate(annotations):
        number = text.split("+")[0][1:]
        if text[:1] == kind and number.isdigit():
            out[i] = int(number)
    return out


def _longest_run(numbers):
    """Longest stretch of consecutive integers: equal value-minus-rank means one run."""
    distinct = np.unique(numbers[numbers >= 0])
    if distinct.size == 0:
        return 0
    return int(np.unique(distinct - np.arange(distinct.size), return_counts=True)[1].max())


def angle_similarity(theoretical, observed):
    if len(theoretical) == 0 or len(observed) == 0:
        return 0.0
    if len(theoretical) != len(observed):
        raise ValueError("theoretical and aligned intensities must have equal length")
    scale = np.linalg.norm(theoretical) * np.linalg.norm(observed)
    if scale == 0.0 or np.isnan(scale):
        return 0.0
    cosine = min(1.0, max(-1.0, float(theoretical @ observed) / scale))
    return float(1.0 - 2.0 * np.arccos(cosine) / np.pi)


def xcorr_score(peak_mz, peak_intensity, ion_mz):
    """Fast cross-correlation: sqrt-binned spectrum, per-window scaling, background removed."""
    if len(peak_mz) == 0 or len(ion_mz) == 0:
        return 0.0

    def bins(mz):
        return (mz / XCORR_BIN_SIZE + XCORR_BIN_OFFSET).astype(np.int64)

    slot = bins(peak_mz)
    n_bins = int(slot.max()) + 1
    if n_bins < XCORR_NUM_WINDOWS:
        return 0.0
    usable = slot >= 0
    spectrum = np.zeros(n_bins)
    np.maximum.at(spectrum, slot[usable], np.sqrt(np.maximum(peak_intensity[usable], 0.0)))
    window = np.minimum(
        np.arange(n_bins) // (n_bins // XCORR_NUM_WINDOWS), XCORR_NUM_WINDOWS - 1
    )
    peak = np.zeros(XCORR_NUM_WINDOWS)
    np.maximum.at(peak, window, spectrum)
    gain = np.divide(
        XCORR_WINDOW_NORM_VALUE, peak, out=np.ones_like(peak), where=peak > 0
    )
    spectrum *= gain[window]
    prefix = np.append(0.0, np.cumsum(spectrum))
    at = np.arange(n_bins)
    around = (
        prefix[np.minimum(at + XCORR_MAX_OFFSET + 1, n_bins)]
        - prefix[np.maximum(at - XCORR_MAX_OFFSET, 0)]
    )
    spectrum -= (around - spectrum) / (2 * XCORR_MAX_OFFSET)
    hits = np.unique(bins(ion_mz))
    return float(spectrum[hits[(hits >= 0) & (hits < n_bins)]].sum())


def _floats(cell):
    return np.empty(0) if cell is None else np.asarray(cell, dtype=np.float64)


def _charges(annotations):
    return np.array([int(a.split("+")[1]) for a in annotations], dtype=np.float64)


def compare(ion_mz, ion_intensity, annotations, peak_mz, peak_intensity, length, tolerance, unit):
    """The nine features of one row, in ``ION_FEATURES`` order."""
    ions, predicted = _floats(ion_mz), _floats(ion_intensity)
    peaks, heights = _floats(peak_mz), _floats(peak_intensity)
    if ions.size == 0:
        return (0.0, 0.0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    names = list(annotations)
    matched, own, envelope = match_peaks(ions, _charges(names), peaks, heights, tolerance, unit)
    b, y = _ion_index(names, "b"), _ion_index(names, "y")
    b_hit, y_hit = b[matched & (b >= 0)], y[matched & (y >= 0)]
    total = heights.sum()
    gaps = np.diff(np.sort(ions[matched]))
    is_b = np.array([a.startswith("b") for a in names]) & matched
    is_y = np.array([a.startswith("y") for a in names]) & matched
    ratio = envelope[is_b].sum() / (envelope[is_y].sum() + 1e-8) if matched.any() else 0.0
    return (
        float(matched.sum() / ions.size),
        float(envelope.sum() / total) if total else 0.0,
        _longest_run(b_hit),
        _longest_run(y_hit),
        int(np.isin(int(length) - np.unique(b_hit), y_hit).sum()),
        float(gaps.max()) if gaps.size else 0.0,
        float(ratio),
        angle_similarity(predicted, own),
        xcorr_score(peaks, heights, ions),
    )


# --- Arrow UDFs -------------------------------------------------------------


def _feature_type() -> T.StructType:
    return T.StructType(
        [
            T.StructField(n, T.IntegerType() if n in _INTEGER_FEATURES else T.DoubleType())
            for n in ION_FEATURES
        ]
    )


def ion_features(
    ion_mz: Column,
    ion_intensity: Column,
    annotations: Column,
    peak_mz: Column,
    peak_intensity: Column,
    peptide_length: Column,
    tolerance: float,
    unit: str,
) -> Column:
    """Struct of the nine ion-match features."""
    unit = check_tolerance(tolerance, unit)

    @F.pandas_udf(_feature_type())
    def score(
        im: pd.Series, ii: pd.Series, an: pd.Series, pm: pd.Series, pi: pd.Series, ln: pd.Series
    ) -> pd.DataFrame:
        rows = [
            compare(a, b, c, d, e, f, tolerance, unit)
            for a, b, c, d, e, f in zip(im, ii, an, pm, pi, ln.fillna(0))
        ]
        return pd.DataFrame(rows, columns=list(ION_FEATURES))

    return score(ion_mz, ion_intensity, annotations, peak_mz, peak_intensity, peptide_length)


def matched_ions(
    ion_mz: Column,
    annotations: Column,
    peak_mz: Column,
    peak_intensity: Column,
    tolerance: float,
    unit: str,
) -> Column:
    """Struct with match rate, matched intensity share and the per-ion match lists."""
    unit = check_tolerance(tolerance, unit)

    @F.pandas_udf(MATCH_TYPE)
    def score(im: pd.Series, an: pd.Series, pm: pd.Series, pi: pd.Series) -> pd.DataFrame:
        rows = []
        for mz, names, peaks, heights in zip(im, an, pm, pi):
            ions, peaks, heights = _floats(mz), _floats(peaks), _floats(heights)
            names = [] if names is None else list(names)
            matched, own, envelope = match_peaks(
                ions, _charges(names), peaks, heights, tolerance, unit
            )
            total = heights.sum()
            rows.append(
                (
                    float(matched.mean()) if ions.size else 0.0,
                    float(envelope.sum() / total) if total else 0.0,
                    [a for a, hit in zip(names, matched) if hit],
                    ions[matched].tolist(),
                    envelope[matched].tolist(),
                    own.tolist(),
                )
            )
        return pd.DataFrame(rows, columns=[f.name for f in MATCH_TYPE.fields])

    return score(ion_mz, annotations, peak_mz, peak_intensity)


def xcorr(peak_mz: Column, peak_intensity: Column, ion_mz: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def score(pm: pd.Series, pi: pd.Series, im: pd.Series) -> pd.Series:
        return pd.Series(
            [xcorr_score(_floats(a), _floats(b), _floats(c)) for a, b, c in zip(pm, pi, im)],
            dtype="float64",
        )

    return score(peak_mz, peak_intensity, ion_mz)


# --- column expressions -----------------------------------------------------


def series_numbers(annotations: Column, kind: str) -> Column:
    """Distinct fragment numbers of one series, e.g. ``b`` of ``[b1+1, y2+1]`` -> ``[1]``."""
    pattern = rf"^{kind}(\d+)(?:\+.*)?$"
    numbers = F.transform(annotations, lambda a: F.regexp_extract(a, pattern, 1))
    return F.array_distinct(
        F.transform(F.filter(numbers, lambda x: x != ""), lambda x: x.cast("int"))
    )


def longest_series(annotations: Column, kind: str) -> Column:
    """Longest consecutive run: fold over the sorted distinct numbers."""

    def state(p, c, m):
        return F.struct(p.alias("p"), c.alias("c"), m.alias("m"))

    def step(z, x):
        run = F.when(x == z["p"] + 1, z["c"] + 1).otherwise(1)
        return state(x, run, F.greatest(z["m"], run))

    return F.aggregate(
        F.array_sort(series_numbers(annotations, kind)),
        state(F.lit(-2), F.lit(0), F.lit(0)),
        step,
        lambda z: z["m"],
    )


def complementary_count(annotations: Column, length: Column) -> Column:
    b, y = series_numbers(annotations, "b"), series_numbers(annotations, "y")
    return F.size(F.array_intersect(b, F.transform(y, lambda v: length - v)))


def largest_gap(mz: Column) -> Column:
    ordered = F.array_sort(mz)
    n = F.size(ordered)
    gaps = F.zip_with(
        F.slice(ordered, F.lit(2), n - 1), F.slice(ordered, F.lit(1), n - 1), lambda b, a: b - a
    )
    return F.when(n < 2, F.lit(0.0)).otherwise(F.array_max(gaps))


def series_ratio(annotations: Column, intensities: Column, epsilon: float = 1e-8) -> Column:
    """Sum of b intensities over (sum of y intensities + epsilon); 0 without ions."""
    pairs = F.arrays_zip(annotations.alias("a"), intensities.alias("i"))

    def total(kind: str) -> Column:
        return F.aggregate(
            pairs,
            F.lit(0.0),
            lambda acc, p: acc + F.when(p["a"].startswith(kind), p["i"]).otherwise(0.0),
        )

    return F.when(F.size(annotations) == 0, F.lit(0.0)).otherwise(
        total("b") / (total("y") + F.lit(epsilon))
    )


def spectral_angle(theoretical: Column, observed: Column) -> Column:
    """``1 - 2*acos(cosine)/pi``; 0 for missing, empty or all-zero input."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(dot(theoretical, theoretical)) * F.sqrt(dot(observed, observed))
    aligned = F.when(
        F.size(theoretical) != F.size(observed),
        F.raise_error(F.lit("intensity lists must have equal length")).cast("double"),
    )
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(theoretical, observed) / norm))
    value = F.lit(1.0) - F.acos(cosine) * F.lit(2.0) / F.lit(float(np.pi))
    empty = (F.size(theoretical) == 0) | (F.size(observed) == 0)
    usable = F.coalesce(~empty, F.lit(False))
    return F.when(~usable, F.lit(0.0)).otherwise(
        F.coalesce(aligned, F.when((norm > 0) & ~F.isnan(norm), value).otherwise(0.0))
    )
