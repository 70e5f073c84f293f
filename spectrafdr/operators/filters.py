"""Row filters, label rules and schema / value checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafdr.functions import peptides as P


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; available: {sorted(df.columns)}")


def require_rows(df: DataFrame, message: str) -> None:
    if df.isEmpty():
        raise ValueError(message)


def check_label_type(df: DataFrame, column: str) -> None:
    """Labels are boolean or numeric; anything else would be coerced silently."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.BooleanType, T.NumericType)):
        raise ValueError(
            f"cannot use {column!r} of type {kind.simpleString()} as a label: boolean or number wanted"
        )


def boolean_labels(df: DataFrame, column: str) -> DataFrame:
    """Cast a label column to boolean; a NULL label fails the job that reads it."""
    check_label_type(df, column)
    value = F.col(column).cast("boolean")
    return df.withColumn(
        column,
        F.coalesce(
            value,
            F.raise_error(F.lit(f"label {column!r} is NULL in some row")).cast(
                "boolean"
            ),
        ),
    )


def drop_where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Remove rows for which any condition is TRUE; NULL counts as FALSE.

    Conditions may use scalar columns and the ``beams`` array alike.
    """
    unwanted = F.lit(False)
    for condition in conditions:
        unwanted = unwanted | F.coalesce(condition, F.lit(False))
    return df.filter(~unwanted)


def drop_where_beams(df: DataFrame, condition: Column) -> DataFrame:
    if "beams" not in df.columns:
        raise ValueError("a beam condition needs a 'beams' column")
    return drop_where(df, condition)


def usable_predictions(df: DataFrame) -> DataFrame:
    if "valid_prediction" in df.columns:
        return df.filter(F.coalesce("valid_prediction", F.lit(False)))
    return df.filter(P.has_tokens(F.col("prediction")))


def labelled(df: DataFrame) -> DataFrame:
    """Rows that may train a model: valid labels if a sequence exists, else all."""
    if "sequence" not in df.columns:
        return df
    require_columns(df, ["valid_sequence", "correct"])
    return df.filter(F.coalesce("valid_sequence", F.lit(False)))


def require_labelled(df: DataFrame, context: str) -> DataFrame:
    rows = labelled(df)
    require_rows(rows, f"{context}: no row has a valid sequence")
    return rows


def drop_empty_labels(df: DataFrame) -> tuple[DataFrame, bool]:
    """(frame, has_labels): an all-empty ``sequence`` column is removed."""
    if "sequence" not in df.columns:
        return df, False
    is_array = isinstance(df.schema["sequence"].dataType, T.ArrayType)
    found = not df.select("sequence").filter(
        P.usable_label(F.col("sequence"), is_array)
    ).isEmpty()
    return (df, True) if found else (df.drop("sequence"), False)


def checked_peptide_columns(df: DataFrame) -> DataFrame:
    """Peptide columns must hold token lists; empty lists become NULL; validity derived."""
    for name in ("prediction", "sequence"):
        if name not in df.columns:
            if name == "prediction":
                raise ValueError("a 'prediction' column is required")
            continue
        if not isinstance(df.schema[name].dataType, T.ArrayType):
            raise ValueError(f"column {name!r} must hold token lists, not raw strings")
        df = df.withColumn(name, P.clean_tokens(F.col(name)))
        df = df.withColumn(f"valid_{name}", P.has_tokens(F.col(name)))
    return df


def model_supports(
    tokens: Column,
    max_length: int,
    unsupported: list[str] | None,
    charge: Column | None = None,
    max_charge: int | None = None,
) -> Column:
    """TRUE when a spectrum / retention-time model accepts the peptide."""
    ok = P.has_tokens(tokens) & (F.size(tokens) <= max_length)
    if unsupported:
        ok = ok & ~F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in unsupported]))
    if charge is not None:
        ok = ok & (charge <= max_charge)
    return F.coalesce(ok, F.lit(False))


def in_range(df: DataFrame, column: str, low: float, high: float, what: str) -> DataFrame:
    """Fail the reading job on a score outside [low, high]; NULL passes."""
    value = F.col(column)
    bad = value.isNotNull() & (F.isnan(value) | (value < low) | (value > high))
    return df.withColumn(
        column,
        F.when(
            bad,
            F.raise_error(
                F.concat(F.lit(f"{what} must be in [{low:g}, {high:g}], got "), value.cast("string"))
            ).cast("double"),
        ).otherwise(value),
    )


def long_enough(df: DataFrame, min_tokens: int = 7) -> DataFrame:
    is_array = isinstance(df.schema["prediction"].dataType, T.ArrayType)
    return df.filter(P.residue_count(F.col("prediction"), is_array) >= min_tokens)
