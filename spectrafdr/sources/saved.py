"""Saved data sets, feature tables and FASTA; and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafdr.functions import peptides as P
from spectrafdr.operators import scale
from spectrafdr.operators.calibrator import numeric_feature_columns
from spectrafdr.operators.filters import checked_peptide_columns, drop_empty_labels, require_columns
from spectrafdr.sources.csv_records import read_csv
from spectrafdr.sources.predictions import finalise

# Columns of a metadata CSV that are text whatever they look like.
TEXT_COLUMNS = (
    "spectrum_id", "experiment_name", "title", "label", "prediction", "prediction_untokenised",
    "sequence", "sequence_untokenised",
)

_WHOLE = r"^(0|-?[1-9][0-9]{0,18})$"
_NAME = r"^[-+]?(0[0-9].*|[0-9]{16,})$"

# --- scans ------------------------------------------------------------------


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``header, sequence`` per record; the record delimiter splits large files."""
    records = spark.read.text(path, lineSep="\n>").select(
        F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("r")
    )
    header = F.substring_index("r", "\n", 1)
    body = F.regexp_replace(F.substring("r", F.length(header) + 2, F.length("r")), r"\s", "")
    return records.select(header.alias("header"), body.alias("sequence")).filter(
        F.length("sequence") > 0
    )


def numeric_list(text: Column) -> Column:
    """``[1, 2]`` or ``[1. 2.]`` -> array<double>; NULL and empty lists -> NULL."""
    inner = F.trim(F.regexp_replace(text, r"[\[\]\n]", " "))
    parts = F.split(F.regexp_replace(inner, r"[,\s]+", ","), ",")
    return F.when(inner != "", F.transform(parts, lambda x: x.cast("double")))


def _filled(name: str) -> Column:
    """A text column with NULL for empty texts."""
    return F.nullif(F.col(f"`{name}`"), F.lit(""))


def typed_cells(df: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """String columns that hold only numbers, or only true and false, as such; one pass.

    Whole numbers become long, so no digit is lost; other numbers double. Numbers with leading
    zeros, and whole ones too long for a long, are names and stay text, as do columns in
    ``skip`` and columns without any value. Empty texts are no values and become NULL in a
    column of numbers or booleans.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if not names:
        return df
    checks = []
    for i, name in enumerate(names):
        value = _filled(name)
        as_long = value.rlike(_WHOLE) & value.try_cast("bigint").isNotNull()
        as_bool = F.lower(value).isin("true", "false")
        checks += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.isNotNull() & ~as_long).alias(f"l{i}"),
            F.count_if(value.isNotNull() & (value.try_cast("double").isNull() | value.rlike(_NAME))).alias(f"d{i}"),
            F.count_if(value.isNotNull() & ~as_bool).alias(f"b{i}"),
        ]
    found = df.agg(*checks).first()
    kinds = {}
    for i, name in enumerate(names):
        if found[f"n{i}"] and not found[f"b{i}"]:
            kinds[name] = "boolean"
        elif found[f"n{i}"] and not found[f"l{i}"]:
            kinds[name] = "bigint"
        elif found[f"n{i}"] and not found[f"d{i}"]:
            kinds[name] = "double"
    return df.withColumns({n: _filled(n).cast(k) for n, k in kinds.items()})


def load_saved(spark: SparkSession, path: str, masses=None) -> DataFrame:
    """A data set written by ``save_dataset`` (parquet), or a metadata CSV folder.

    CSV peptide strings are tokenised again and list cells are parsed; validity and
    correctness are re-derived in both cases.
    """
    if path.endswith(".csv"):
        raw = read_csv(spark, path)
        for name in ("mz_array", "intensity_array"):
            if name in raw.columns:
                raw = raw.withColumn(name, numeric_list(F.col(name)))
        numbers = {
            "confidence": "double", "precursor_mz": "double", "retention_time": "double",
            "precursor_charge": "int", "scan_number": "bigint",
        }
        raw = raw.withColumns({c: _filled(c).cast(t) for c, t in numbers.items() if c in raw.columns})
        raw = typed_cells(raw, skip=TEXT_COLUMNS)
        df, has_labels = drop_empty_labels(raw)
        return finalise(df, has_labels, None, masses)
    df, has_labels = drop_empty_labels(spark.read.option("mergeSchema", "true").parquet(path))
    return finalise(df, has_labels, None, masses)


def load_features(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """(rows, feature columns) of saved training matrices; files are unioned by name."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    for one in paths:  # footers only
        missing = sorted(set(df.columns) - set(spark.read.parquet(one).columns))
        if missing:
            raise ValueError(f"feature files differ: {one!r} has no column {missing}")
    require_columns(df, ["correct", "confidence"])
    for name in ("correct", "confidence"):
        if not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType)):
            raise ValueError(f"column {name!r} must be numeric or boolean")
    columns = numeric_feature_columns(df)
    picked = [F.col(f"`{c}`").cast("double").alias(c) for c in ["confidence", *columns]]
    return df.select(*picked, F.col("correct").cast("boolean").alias("correct")), columns


def load_regressors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("experiment_name", "slope", "intercept")


# --- projections for export -------------------------------------------------


def export_metadata(df: DataFrame) -> DataFrame:
    """Peptides as ProForma strings; raw strings and validity flags dropped."""
    df = checked_peptide_columns(df)
    for name in ("prediction", "sequence"):
        if name in df.columns:
            df = df.withColumn(name, P.proforma(F.col(name)))
    return df.drop("prediction_untokenised", "valid_prediction", "valid_sequence")


def split_outputs(df: DataFrame, score: str) -> tuple[DataFrame, DataFrame]:
    """(metadata without prediction and FDR columns, id + prediction / FDR columns)."""
    moved = ["prediction", score, "psm_fdr", "psm_q_value"]
    if "psm_pep" in df.columns:
        moved.append("psm_pep")
    if "sequence" in df.columns:
        moved += [c for c in ("sequence", "num_matches", "correct") if c in df.columns]
    require_columns(df, ["spectrum_id", *moved])
    return df.drop(*moved), df.select("spectrum_id", *moved)


def _flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, as a CSV cell needs."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[
            F.to_json(f"`{f.name}`").alias(f.name)
            if isinstance(f.dataType, nested)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# --- sinks ------------------------------------------------------------------


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """``.parquet`` or ``.csv`` by suffix."""
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    elif path.endswith(".csv"):
        _flat(df).write.mode(mode).csv(path, header=True, quote='"', escape='"')
    else:
        raise ValueError(f"unsupported output {path!r}; use .parquet or .csv")


def save_metadata(df: DataFrame, path: str, mode: str = "error") -> None:
    write_table(export_metadata(df), path, mode)


def save_dataset(df: DataFrame, path: str, mode: str = "error") -> None:
    """Metadata and beams in one parquet table: beams are a column."""
    df.write.mode(mode).parquet(path)


def save_predictions(df: DataFrame, folder: str, score: str, mode: str = "error") -> None:
    """Two tables, ``metadata`` and ``preds_and_fdr_metrics``, without beams."""
    exported = scale.store(export_metadata(df.drop("beams")))  # computed once for two sinks
    metadata, predictions = split_outputs(exported, score)
    write_table(metadata, f"{folder}/metadata.csv", mode)
    write_table(predictions, f"{folder}/preds_and_fdr_metrics.csv", mode)


def save_matrix(df: DataFrame, columns: list[str], path: str, mode: str = "error") -> None:
    """``[confidence, *columns, correct?]``."""
    keep = ["confidence", *columns] + (["correct"] if "correct" in df.columns else [])
    require_columns(df, keep)
    df.select(*[F.col(f"`{c}`") for c in keep]).write.mode(mode).parquet(path)


def save_regressors(fitted: DataFrame, path: str, mode: str = "error") -> None:
    usable = fitted.filter(F.col("status").startswith("ok")) if "status" in fitted.columns else fitted
    usable.select("experiment_name", "slope", "intercept").write.mode(mode).parquet(path)


def save_report(diagnostic: DataFrame, path: str, mode: str = "error") -> None:
    """A one-row diagnostic as JSON."""
    diagnostic.coalesce(1).write.mode(mode).json(path)


