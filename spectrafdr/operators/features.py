"""Per-PSM quality features and the registry that applies them.

A feature is any callable ``DataFrame -> DataFrame`` with a ``name`` and the list of
``columns`` it adds; ``CustomFeature`` wraps a user function. The column-only
features are pure expressions, so any number of them fuses into one projection.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from spectrafdr.constants import (
    CARBON_ISOTOPE_MASS_SHIFT,
    H2O_MASS,
    PROTON_MASS,
)
from spectrafdr.functions import peptides as P
from spectrafdr.functions.scores import check_tolerance
from spectrafdr.functions.spectra import ION_FEATURES, ion_features
from spectrafdr.operators import scale
from spectrafdr.operators.filters import model_supports, require_columns

# --- column features --------------------------------------------------------


def mass_error_struct(
    tokens: Column,
    mz: Column,
    charge: Column,
    isotope_range: tuple[int, int] = (0, 1),
    masses: Mapping[str, float] | None = None,
) -> Column:
    """``struct(abs_ppm, rank, ppm, da)`` of the isotope with the least absolute ppm."""
    checked = F.when(P.has_tokens(tokens), tokens).otherwise(
        F.raise_error(F.lit("prediction is not a non-empty token list")).cast("array<string>")
    )
    neutral = P.array_sum(P.residue_mass_list(checked, masses)) + F.lit(H2O_MASS)
    # The theoretical m/z is bound once; the isotopes are a short literal array.
    theoretical = F.array((neutral + charge * F.lit(PROTON_MASS)) / charge)

    def candidates(theory: Column) -> Column:
        options = []
        for rank, isotope in enumerate(range(isotope_range[0], isotope_range[1] + 1)):
            delta = theory - (mz - F.lit(isotope * CARBON_ISOTOPE_MASS_SHIFT) / charge)
            ppm = delta / mz * F.lit(1e6)
            options.append(
                F.struct(
                    F.abs(ppm).alias("abs_ppm"),
                    F.lit(rank).alias("rank"),
                    ppm.alias("ppm"),
                    (delta * charge).alias("da"),
                )
            )
        return F.array_min(F.array(*options))

    return F.get(F.transform(theoretical, candidates), F.lit(0))


@dataclass(frozen=True)
class MassError:
    """Signed precursor mass error; ``unit`` is ``ppm`` or ``da``."""

    unit: str = "ppm"
    isotope_range: tuple[int, int] = (0, 1)
    masses: Mapping[str, float] | None = None

    @property
    def name(self) -> str:
        return f"mass error ({self.unit})"

    @property
    def columns(self) -> list[str]:
        return [f"mass_error_{self.unit}"]

    def __call__(self, df: DataFrame) -> DataFrame:
        require_columns(df, ["prediction", "precursor_mz", "precursor_charge"])
        best = mass_error_struct(
            F.col("prediction"),
            F.col("precursor_mz"),
            F.col("precursor_charge"),
            self.isotope_range,
            self.masses,
        )
        return df.withColumn(self.columns[0], best[self.unit])


@dataclass(frozen=True)
class SequenceLength:
    """Token count; the precursor charge is passed through as a model input."""

    name: str = "sequence"
    columns: tuple[str, ...] = ("sequence_length", "precursor_charge")

    def __call__(self, df: DataFrame) -> DataFrame:
        require_columns(df, ["prediction", "precursor_charge"])
        return df.withColumn("sequence_length", F.size("prediction"))


def _mean(values: Column) -> Column:
    return P.array_sum(values) / F.size(values)


def _population_std(values: Column) -> Column:
    """Two-pass population standard deviation of an array."""

    def spread(mean: Column) -> Column:
        squares = F.transform(values, lambda v: (v - mean) * (v - mean))
        return F.sqrt(_mean(squares))

    return F.get(F.transform(F.array(_mean(values)), spread), F.lit(0))


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


@dataclass(frozen=True)
class TokenScores:
    """Lowest token probability of the top beam and their population deviation."""

    name: str = "token scores"
    columns: tuple[str, ...] = ("min_token_probability", "std_token_probability")

    def __call__(self, df: DataFrame) -> DataFrame:
        require_columns(df, ["beams"])
        logs = F.get("beams", F.lit(0))["token_log_probs"]
        checked = F.coalesce(
            P.clean_tokens(logs),
            F.raise_error(F.lit("token scores need token_log_probs on the top beam")).cast(
                "array<double>"
            ),
        )
        staged = df.withColumn("_p", F.transform(checked, lambda x: F.exp(x)))
        std = F.when(F.size("_p") > 1, _population_std(F.col("_p"))).otherwise(0.0)
        return staged.withColumns(
            {"min_token_probability": F.array_min("_p"), "std_token_probability": std}
        ).drop("_p")


@dataclass(frozen=True)
class BeamStatistics:
    """How far the top candidate stands out from the runners-up."""

    name: str = "beams"
    columns: tuple[str, ...] = ("margin", "median_margin", "entropy", "z-score", "edit_distance")

    def __call__(self, df: DataFrame) -> DataFrame:
        require_columns(df, ["beams"])
        beams = F.coalesce(F.col("beams"), F.array().cast(df.schema["beams"].dataType))
        staged = df.withColumn("_p", F.transform(beams, lambda b: F.exp(b["log_prob"])))
        p = F.col("_p")
        top = F.coalesce(F.get(p, F.lit(0)), F.lit(0.0))
        second = F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))
        staged = staged.withColumn(
            "_r",
            F.when(F.size(p) >= 2, F.slice(p, F.lit(2), F.size(p) - 1)).otherwise(
                F.array(F.lit(0.0))
            ),
        )
        runners = F.col("_r")

        def entropy(total: Column) -> Column:
            terms = F.transform(
                runners, lambda r: F.when(r > 0, -(r / total) * F.log(r / total)).otherwise(0.0)
            )
            return F.when(total != 0, P.array_sum(terms)).otherwise(0.0)

        std = F.when(F.size(p) > 0, _population_std(p))
        z = F.get(
            F.transform(F.array(std), lambda s: F.when(s != 0, (top - _mean(p)) / s)), F.lit(0)
        )
        empty = F.array().cast("array<string>")
        for name, rank in (("_a", 0), ("_b", 1)):
            tokens = F.coalesce(F.get(F.col("beams"), F.lit(rank))["sequence"], empty)
            staged = staged.withColumn(name, P.leucine_to_isoleucine(tokens))
        a, b = F.col("_a"), F.col("_b")
        comparable = (F.size(p) >= 2) & ((F.size(a) > 0) | (F.size(b) > 0))
        return staged.withColumns(
            {
                "margin": top - second,
                "median_margin": top - _median(runners),
                "entropy": F.get(F.transform(F.array(P.array_sum(runners)), entropy), F.lit(0)),
                "z-score": F.coalesce(z, F.lit(0.0)),
                "edit_distance": F.when(comparable, P.token_edit_distance(a, b)).otherwise(1.0),
            }
        ).drop("_p", "_r", "_a", "_b")


@dataclass(frozen=True)
class Dependency:
    """A shared step that several features need; it runs once, before all of them."""

    name: str
    function: Callable[[DataFrame], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.function(df)


@dataclass(frozen=True)
class CustomFeature:
    name: str
    columns: list[str]
    function: Callable[[DataFrame], DataFrame]
    dependencies: tuple[Dependency, ...] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.function(df)


# --- predicted spectra ------------------------------------------------------


def ions_to_arrays(ions: DataFrame) -> DataFrame:
    """Long predicted-ion table -> one row per spectrum with m/z-ordered arrays.

    The list aggregation shuffles once by spectrum; its groups are single predicted
    spectra, which are the output cells themselves.
    """
    entry = F.struct("mz", "intensities", "annotation")
    grouped = ions.groupBy("spectrum_id").agg(
        F.first("peptide_sequences", ignorenulls=True).alias("peptide_sequences"),
        F.first("precursor_charges", ignorenulls=True).alias("precursor_charges"),
        F.first("collision_energies", ignorenulls=True).alias("collision_energies"),
        F.array_sort(F.collect_list(entry)).alias("_ions"),
    )
    return grouped.select(
        "spectrum_id",
        "peptide_sequences",
        "precursor_charges",
        "collision_energies",
        F.transform("_ions", lambda x: x["mz"]).alias("mz"),
        F.transform("_ions", lambda x: x["intensities"]).alias("intensities"),
        F.transform("_ions", lambda x: x["annotation"]).alias("annotation"),
    )


def model_inputs(
    df: DataFrame,
    required: list[str],
    automatic: list[str],
    constants: Mapping[str, object] | None = None,
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add each required model input from a constant or from a column.

    An input given twice, or not at all, is an error.
    """
    constants, columns = dict(constants or {}), dict(columns or {})
    twice = sorted(set(constants) & set(columns))
    if twice:
        raise ValueError(f"model inputs given both as constant and as column: {twice}")
    missing = [r for r in required if r not in {*automatic, *constants, *columns}]
    if missing:
        raise ValueError(f"model inputs without a value: {missing}")
    absent = [c for k, c in columns.items() if k in required and c not in df.columns]
    if absent:
        raise ValueError(f"model input columns {absent} not found; available: {sorted(df.columns)}")
    added = {k: F.lit(constants[k]) for k in required if k in constants and k not in automatic}
    added |= {k: F.col(columns[k]) for k in required if k in columns and k not in automatic}
    return df.withColumns(added) if added else df


def _missing_policy(df: DataFrame, valid: Column, flag: str, learn_from_missing: bool) -> DataFrame:
    """Flag invalid rows (to be imputed), or drop them before later features run."""
    flagged = df.withColumn(flag, ~valid)
    return flagged if learn_from_missing else flagged.filter(~F.col(flag))


@dataclass(frozen=True)
class FragmentMatch:
    """Agreement of the observed with a predicted spectrum.

    ``ions`` is the predicted-ion table (long form); ``ions_are_arrays`` accepts one
    row per spectrum instead. ``runner_up`` compares the second beam (``chimeric_``
    columns) in place of the prediction.
    """

    ions: DataFrame
    mz_tolerance: float
    mz_tolerance_unit: str
    learn_from_missing: bool = True
    max_precursor_charge: int = 6
    max_peptide_length: int = 30
    unsupported_residues: list[str] = field(default_factory=list)
    runner_up: bool = False
    ions_are_arrays: bool = False

    def __post_init__(self):
        check_tolerance(self.mz_tolerance, self.mz_tolerance_unit)

    @property
    def name(self) -> str:
        return "chimeric fragment match" if self.runner_up else "fragment match"

    @property
    def _flag(self) -> str:
        return (
            "is_missing_chimeric_features"
            if self.runner_up
            else "is_missing_fragment_match_features"
        )

    @property
    def _prefix(self) -> str:
        return "chimeric_" if self.runner_up else ""

    @property
    def columns(self) -> list[str]:
        own = [self._prefix + c for c in ION_FEATURES]
        return own + ([self._flag] if self.learn_from_missing else [])

    @property
    def array_columns(self) -> list[str]:
        lead = "runner_up" if self.runner_up else "theoretical"
        return [f"{lead}_mz", f"{lead}_intensity", f"{lead}_annotation"]

    def valid(self) -> Column:
        tokens = F.get("beams", F.lit(1))["sequence"] if self.runner_up else F.col("prediction")
        ok = model_supports(
            tokens,
            self.max_peptide_length,
            self.unsupported_residues,
            F.col("precursor_charge"),
            self.max_precursor_charge,
        )
        if self.runner_up:
            ok = ok & F.coalesce(F.size("beams") >= 2, F.lit(False))
        return ok

    def __call__(self, df: DataFrame) -> DataFrame:
        needed = ["spectrum_id", "precursor_charge", "mz_array", "intensity_array"]
        require_columns(df, needed + (["beams"] if self.runner_up else ["prediction"]))
        tokens = F.get("beams", F.lit(1))["sequence"] if self.runner_up else F.col("prediction")
        rows = _missing_policy(df, self.valid(), self._flag, self.learn_from_missing)
        arrays = self.ions if self.ions_are_arrays else ions_to_arrays(self.ions)
        mz, intensity, annotation = self.array_columns
        predicted = arrays.select(
            "spectrum_id",
            F.col("mz").alias(mz),
            F.col("intensities").alias(intensity),
            F.col("annotation").alias(annotation),
        )
        joined = rows.join(predicted, "spectrum_id", "left")
        # Rows that the model does not support keep no predicted spectrum.
        cleared = joined.withColumns(
            {c: F.when(~F.col(self._flag), F.col(c)) for c in self.array_columns}
        )
        scored = cleared.withColumn(
            "_s",
            ion_features(
                F.col(mz),
                F.col(intensity),
                F.col(annotation),
                F.col("mz_array"),
                F.col("intensity_array"),
                F.coalesce(F.size(tokens), F.lit(0)),
                float(self.mz_tolerance),
                self.mz_tolerance_unit,
            ),
        )
        return scored.withColumns(
            {self._prefix + c: F.col("_s")[c] for c in ION_FEATURES}
        ).drop("_s")


# --- retention time ---------------------------------------------------------

GLOBAL_EXPERIMENT = "__global__"


def top_fraction(
    df: DataFrame, group: str, score: str, tie: str, fraction: float
) -> DataFrame:
    """The best ``max(1, int(fraction * n))`` rows per group by score.

    Group sizes come from one map-side combined count. While every group fits a
    bucket a window per group ranks it; a larger group is range-partitioned by
    (group, score, tie) so that it spans many tasks.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    extent = sizes.agg(
        F.max("_n").alias("largest"), F.sum("_n").alias("rows"), F.count("*").alias("groups")
    ).first()
    order = [F.col(score).desc_nulls_last(), F.col(tie).asc()]
    if (extent["largest"] or 0) <= scale.ROWS_PER_BUCKET:
        w = Window.partitionBy(group).orderBy(*order)
        # The group size rides on the same exchange as the rank.
        ranked = df.withColumns(
            {
                "_rank": F.row_number().over(w),
                "_n": F.count(F.lit(1)).over(Window.partitionBy(group)),
            }
        )
    else:
        keys = [F.col(group).asc(), *order]
        ranked = scale.running_totals(
            scale.order_buckets(df, keys, extent["rows"]),
            order,
            {"_rank": F.lit(1)},
            extent["rows"],
            inclusive=True,
            within=[group],
        ).drop("_bucket")
        small = extent["groups"] <= scale.BROADCAST_ROWS
        ranked = ranked.join(F.broadcast(sizes) if small else sizes, group)
    quota = F.greatest(F.lit(1), F.floor(F.lit(float(fraction)) * F.col("_n")))
    return ranked.filter(F.col("_rank") <= quota).drop("_rank", "_n")


def fit_regressors(
    train: DataFrame, group: str, rt: str, irt: str, peptide: str, min_train_points: int
) -> DataFrame:
    """Per-group least squares of ``irt`` on ``rt`` with the reason a group is unusable.

    Sums for the regression combine on the map side, so a dominant group is fine.
    """
    # Only rows with both values take part in a regression, so only they are counted.
    usable = F.col(rt).isNotNull() & F.col(irt).isNotNull()
    fitted = train.groupBy(group).agg(
        F.count_if(usable).alias("n_train"),
        F.countDistinct(F.when(usable, F.col(peptide))).alias("n_peptides"),
        (F.min(F.when(usable, F.col(rt))) < F.max(F.when(usable, F.col(rt)))).alias("_rt_varies"),
        F.regr_slope(irt, rt).alias("slope"),
        F.regr_intercept(irt, rt).alias("intercept"),
    )
    status = (
        F.when(F.col("n_peptides") < 2, "too few distinct peptides")
        .when(~F.coalesce("_rt_varies", F.lit(False)), "too few distinct retention times")
        .when(F.col("n_train") < min_train_points, "too few training points")
        .when(F.col("n_peptides") < min_train_points, "ok, few distinct peptides")
        .otherwise("ok")
    )
    return fitted.select(
        F.col(group),
        "slope",
        "intercept",
        "n_train",
        "n_peptides",
        status.alias("status"),
    )


@dataclass
class RetentionTime:
    """Absolute error between the peptide's indexed and the run-calibrated retention time.

    ``irt_table`` holds one row per ProForma ``peptide`` with its ``irt``. Loaded
    ``regressors`` (``experiment_name, slope, intercept``) are pinned: only other
    experiments are fitted on the data passed in.
    """

    irt_table: DataFrame
    train_fraction: float = 0.1
    min_train_points: int = 10
    learn_from_missing: bool = True
    max_peptide_length: int = 30
    unsupported_residues: list[str] = field(default_factory=list)
    regressors: DataFrame | None = None
    fitted: DataFrame | None = field(default=None, init=False)
    name: str = "retention time"

    @property
    def columns(self) -> list[str]:
        return ["irt_error"] + (["is_missing_irt_error"] if self.learn_from_missing else [])

    def _with_irt(self, df: DataFrame) -> DataFrame:
        """Attach the peptide's iRT; one peptide may cover a large share of the rows."""
        table = self.irt_table.select(F.col("peptide").alias("_pep"), F.col("irt").alias("iRT"))
        return scale.attach(df, table, "_pep", salt_on=["spectrum_id"])

    def _prepare(self, df: DataFrame) -> DataFrame:
        require_columns(df, ["spectrum_id", "prediction", "retention_time", "confidence"])
        group = (
            F.col("experiment_name").cast("string")
            if "experiment_name" in df.columns
            else F.lit(GLOBAL_EXPERIMENT)
        )
        valid = model_supports(
            F.col("prediction"), self.max_peptide_length, self.unsupported_residues
        )
        return df.withColumns(
            {"_exp": group, "_ok": valid, "_pep": P.proforma(F.col("prediction"))}
        )

    def fit(self, df: DataFrame) -> DataFrame:
        """Regressors of every experiment of ``df`` that is not pinned.

        The top fraction is cut first, so only its rows look up their iRT.
        """
        rows = self._prepare(df).select(
            "_exp", "_ok", "spectrum_id", "confidence", "retention_time", "_pep"
        )
        if self.regressors is not None:
            pinned = self.regressors.select(F.col("experiment_name").alias("_exp"))
            rows = rows.join(pinned, "_exp", "left_anti")
        train = top_fraction(
            rows.filter("_ok"), "_exp", "confidence", "spectrum_id", self.train_fraction
        )
        fresh = fit_regressors(
            self._with_irt(train), "_exp", "retention_time", "iRT", "_pep", self.min_train_points
        ).withColumnRenamed("_exp", "experiment_name")
        self.fitted = scale.materialise(fresh)
        return self.fitted

    def _has_global(self) -> bool:
        """Whether rows without experiments already have their regressor, which then stays."""
        known = [t for t in (self.fitted, self.regressors) if t is not None]
        is_global = F.col("experiment_name") == GLOBAL_EXPERIMENT
        return any(not t.filter(is_global).isEmpty() for t in known)

    def __call__(self, df: DataFrame) -> DataFrame:
        if "experiment_name" in df.columns or not self._has_global():
            self.fit(df)
        usable = None
        for table in (self.fitted, self.regressors):
            if table is None:
                continue
            if "status" in table.columns:
                table = table.filter(F.col("status").startswith("ok"))
            table = table.select(F.col("experiment_name").alias("_exp"), "slope", "intercept")
            usable = table if usable is None else usable.unionByName(table)
        rows = self._with_irt(self._prepare(df))
        joined = scale.attach(rows, usable, "_exp", salt_on=["spectrum_id"])
        valid = F.col("_ok") & F.col("slope").isNotNull()
        flagged = _missing_policy(joined, valid, "is_missing_irt_error", self.learn_from_missing)
        predicted = F.col("slope") * F.col("retention_time") + F.col("intercept")
        return (
            flagged.withColumns(
                {
                    "iRT": F.when(F.col("_ok"), F.col("iRT")),
                    "predicted iRT": predicted,
                }
            )
            .withColumn(
                "irt_error",
                F.coalesce(F.abs(F.col("predicted iRT") - F.col("iRT")), F.lit(0.0)),
            )
            .drop("_exp", "_ok", "_pep", "slope", "intercept")
        )


# --- registry ---------------------------------------------------------------


class FeatureSet:
    """Ordered features with shared, reference-counted dependencies.

    A dependency is a callable ``DataFrame -> DataFrame`` that several features
    need; it runs once, before all features, while any registered feature names it.
    """

    def __init__(self, *features):
        self._features: dict[str, object] = {}
        self._dependencies: dict[str, tuple[Callable, int]] = {}
        for feature in features:
            self.add(feature)

    def add(self, feature) -> None:
        if feature.name in self._features:
            raise KeyError(f"feature {feature.name!r} is already registered")
        self._features[feature.name] = feature
        for dep in getattr(feature, "dependencies", ()):
            known, uses = self._dependencies.get(dep.name, (dep, 0))
            self._dependencies[dep.name] = (known, uses + 1)

    def remove(self, name: str) -> None:
        feature = self._features.pop(name)
        for dep in getattr(feature, "dependencies", ()):
            known, uses = self._dependencies[dep.name]
            if uses > 1:
                self._dependencies[dep.name] = (known, uses - 1)
            else:
                del self._dependencies[dep.name]

    @property
    def names(self) -> list[str]:
        return list(self._features)

    @property
    def dependency_names(self) -> list[str]:
        return list(self._dependencies)

    @property
    def columns(self) -> list[str]:
        return [c for f in self._features.values() for c in f.columns]

    def __call__(self, df: DataFrame) -> DataFrame:
        steps = [dep for dep, _ in self._dependencies.values()] + list(self._features.values())
        return functools.reduce(lambda frame, step: step(frame), steps, df)


def _missing_counters(df: DataFrame) -> list[Column]:
    """Row count, rows with fewer than two beams, and rows per missing-flag column."""
    parts = [F.count("*").alias("n_rows")]
    if "beams" in df.columns:
        short = F.coalesce(F.size("beams"), F.lit(0)) < 2
        parts.append(F.count_if(short).alias("n_short_beams"))
    parts += [
        F.count_if(F.col(c)).alias(f"n_{c}") for c in df.columns if c.startswith("is_missing_")
    ]
    return parts


def count_missing(df: DataFrame, counters: Observation) -> DataFrame:
    """``df`` unchanged; the first job that reads it fills ``counters`` (see ``counters.get``)."""
    return df.observe(counters, *_missing_counters(df))


def missing_counts(df: DataFrame) -> DataFrame:
    """The counters of rows that are stored already, in one row."""
    return df.agg(*_missing_counters(df))


