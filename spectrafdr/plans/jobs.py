"""End-to-end jobs over PSM tables: compute features, train, predict, diagnose, annotate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spectrafdr.operators import diagnostics, fdr, scale
from spectrafdr.operators.calibrator import (
    ProbabilityCalibrator,
    TrainingHistory,
    feature_matrix,
)
from spectrafdr.operators.features import FeatureSet, count_missing
from spectrafdr.operators.filters import (
    labelled,
    require_labelled,
    require_rows,
    usable_predictions,
)
from spectrafdr.operators.proteome import annotate_hits, annotation_counts
from spectrafdr.operators.split import named_rows, random_split
from spectrafdr.sources import saved


def union_experiments(frames: list[DataFrame]) -> DataFrame:
    """Column union of per-experiment results; absent columns become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def compute_features(
    psms: DataFrame,
    features: FeatureSet,
    filter_empty: bool = True,
    metadata_path: str | None = None,
    matrix_path: str | None = None,
    counters: Observation | None = None,
) -> DataFrame:
    """Usable predictions with all features; optionally stored as metadata and matrix.

    ``counters`` is filled with the numbers of rows and of missing inputs by the same job that
    computes the features.
    """
    rows = usable_predictions(psms) if filter_empty else psms
    out = features(rows)
    if counters is not None:
        out = count_missing(out, counters)
    if metadata_path or matrix_path:
        out = scale.store(out)  # two sinks read it
        require_rows(out, "no spectra left after feature computation")
    if metadata_path:
        saved.save_metadata(out.drop("beams"), metadata_path)
    if matrix_path:
        saved.save_matrix(labelled(out), features.columns, matrix_path)
    return out


@dataclass
class Trained:
    model: ProbabilityCalibrator
    history: TrainingHistory
    rows: DataFrame | None


def train(
    psms: DataFrame | None = None,
    features: FeatureSet | None = None,
    model: ProbabilityCalibrator | None = None,
    features_path: str | list[str] | None = None,
    val_features_path: str | list[str] | None = None,
    validation_fraction: float = 0.1,
    spark: SparkSession | None = None,
    id_column: str = "spectrum_id",
    training_feature_columns: list[str] | None = None,
    **hyperparameters,
) -> Trained:
    """Fit a calibrator from PSM rows, or from saved feature tables.

    Features are computed on all rows once, before the validation split.
    ``training_feature_columns`` narrows the model inputs to some of the feature
    columns; a given ``model`` brings its own.
    """

    def chosen(available: list[str]) -> list[str]:
        unknown = [c for c in training_feature_columns or [] if c not in available]
        if unknown:
            raise ValueError(f"unknown training feature column(s) {unknown}; known: {available}")
        return training_feature_columns or available

    if features_path is not None:
        rows, columns = saved.load_features(spark, features_path)
        model = model or ProbabilityCalibrator(chosen(columns), **hyperparameters)
        if val_features_path is not None:
            val, _ = saved.load_features(spark, val_features_path)
            return Trained(model, model.fit(rows, val), None)
        fit_rows, val = random_split(named_rows(rows, "_id"), "_id", validation_fraction, model.seed)
        return Trained(model, model.fit(fit_rows, val, id_column="_id"), None)
    out = scale.store(compute_features(psms, features))
    require_labelled(out, "training")
    model = model or ProbabilityCalibrator(chosen(features.columns), **hyperparameters)
    matrix = feature_matrix_with_id(labelled(out), model.feature_columns, id_column)
    fit_rows, val = random_split(matrix, id_column, validation_fraction, model.seed)
    return Trained(model, model.fit(fit_rows, val, id_column=id_column), out)


def feature_matrix_with_id(df: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """Training matrix plus the id that splits and samples hash."""
    keep = [F.col(f"`{c}`").cast("double").alias(c) for c in ["confidence", *columns]]
    return df.select(F.col(id_column), *keep, F.col("correct").cast("boolean").alias("correct"))


def predict(
    psms: DataFrame,
    model: ProbabilityCalibrator,
    features: FeatureSet,
    threshold: float = 0.05,
    method: str = "label_free",
    score: str = "calibrated_confidence",
    drop: int = 10,
    output_folder: str | None = None,
    keep_all_without_cutoff: bool = False,
) -> DataFrame:
    """Features -> calibrated confidence -> FDR columns -> filter at the threshold.

    The scored rows are stored once, without the beams that only features need: fitting
    the curve and annotating both read them, and neither repeats the feature computation.
    """
    if method not in ("label_free", "label_based"):
        raise ValueError(f"unknown FDR method {method!r}")
    scored = scale.store(
        model.predict(compute_features(psms, features), check_empty=False).drop("beams")
    )
    require_rows(scored, "no spectra left after feature computation")
    if method == "label_free":
        curve = fdr.fit_label_free(scored, score)
    else:
        curve = fdr.fit_label_based(scored, score, drop=drop)
    out = fdr.control_fdr(
        scored,
        score,
        threshold,
        curve,
        same_scores=method == "label_free",
        pep=method == "label_free",
        keep_all_without_cutoff=keep_all_without_cutoff,
    )
    if output_folder:
        saved.save_predictions(out, output_folder, score)
    return out


def diagnose(
    scored: DataFrame,
    threshold: float = 0.05,
    score: str = "calibrated_confidence",
    label_source: str = "sequence",
    label_column: str | None = None,
    tolerance: float = 0.005,
    min_tail_psms: int = 100,
    report_path: str | None = None,
) -> DataFrame:
    """Tail calibration at the label-free cut-off of the same labelled rows."""
    rows, label = diagnostics.resolve_labels(scored, label_source, label_column)
    rows = scale.materialise(rows.select(score, label))  # read by the curve, the cut-off and the tail
    curve = fdr.fit_label_free(rows, score)
    cutoff = fdr.confidence_cutoff(curve, threshold)
    if cutoff is None:
        raise ValueError(f"no score reaches an FDR of {threshold}")
    result = diagnostics.tail_diagnostic(
        rows, score, label, cutoff, threshold, tolerance, label_source, min_tail_psms
    )
    if report_path:
        saved.save_report(result, report_path)
    return result


def annotate_proteome(
    psms: DataFrame, proteins: DataFrame, min_residue_length: int = 7, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(annotated rows, row counts) for usable predictions."""
    rows = usable_predictions(psms)
    out = annotate_hits(rows, proteins, min_residue_length)
    if path:
        saved.save_dataset(out, path)
    return out, annotation_counts(rows, min_residue_length)


__all__ = [
    "Trained", "annotate_proteome", "compute_features", "diagnose", "feature_matrix", "predict",
    "train", "union_experiments",
]
