"""Prediction scans and the loaders that turn files into canonical PSM rows."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafdr.constants import (
    BEAM_CSV_REMAPPING,
    BEAM_ENGINE_MARKERS,
    BEAM_TYPE,
    MZTAB_REMAPPING,
    TITLE_TSV_NTERM_MODS,
    TITLE_TSV_REMAPPING,
)
from spectrafdr.functions import peptides as P
from spectrafdr.functions import scores as S
from spectrafdr.operators import scale
from spectrafdr.operators.filters import drop_where, in_range, require_columns, require_rows
from spectrafdr.operators.joins import check_unique, join_spectra
from spectrafdr.sources.spectra import run_names, scan_spectra

# Default column prefixes of the beam CSV; a beam index follows each prefix.
BEAM_PREFIXES = {
    "sequence": "predictions_beam_",
    "log_probability": "predictions_log_probability_beam_",
    "token_log_probabilities": "predictions_token_log_probabilities_beam_",
}
BEAM_CSV_COLUMNS = {
    "predictions": "predictions",
    "predictions_tokenised": "predictions_tokenised",
    "log_probability": "log_probs",
}
MZTAB_COLUMNS = {
    "predictions": "opt_ms_run[1]_proforma",
    "confidence": "search_engine_score[1]",
    "token_scores": "opt_ms_run[1]_aa_scores",
}


def check_suffix(path: str, suffixes: tuple[str, ...]) -> None:
    if not path.lower().rstrip("/").endswith(suffixes):
        raise ValueError(f"unsupported prediction file {path!r}; supported: {suffixes}")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def finalise(
    df: DataFrame,
    has_labels: bool,
    remapping: Mapping[str, str] | None,
    masses: Mapping[str, float] | None = None,
    score: str = "confidence",
) -> DataFrame:
    """Canonical tokens, validity flags, residue matches and correctness.

    A missing or NaN score makes the prediction invalid: it could not be ranked.
    """

    def canonical(name: str) -> Column:
        is_array = isinstance(df.schema[name].dataType, T.ArrayType)
        return P.normalise_peptide(F.col(name), is_array, remapping)

    df = df.withColumn("prediction", canonical("prediction"))
    ok = P.has_tokens(F.col("prediction"))
    if score in df.columns:
        ok = ok & F.col(score).isNotNull() & ~F.coalesce(F.isnan(score), F.lit(False))
    df = df.withColumn("valid_prediction", ok)
    if not has_labels:
        return df
    df = df.withColumn("sequence", canonical("sequence"))
    df = df.withColumn("valid_sequence", P.has_tokens(F.col("sequence")))
    both = F.col("valid_sequence") & F.col("valid_prediction")
    df = df.withColumn(
        "num_matches",
        F.when(both, P.residue_matches(F.col("sequence"), F.col("prediction"), masses)).otherwise(0),
    )
    return df.withColumn(
        "correct",
        P.is_correct(F.col("num_matches"), F.col("sequence"), F.col("prediction"), both),
    )


# --- beam CSV ---------------------------------------------------------------


def scan_beam_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings: nothing is guessed from the data."""
    check_suffix(path, (".csv",))
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"')


def beam_indices(columns: list[str], prefixes: Mapping[str, str]) -> list[int]:
    """Beam numbers for which columns exist; every prefix needs at least one."""
    found: dict[str, set[int]] = {}
    for prefix in prefixes.values():
        numbers = {
            int(m.group(1)) for c in columns if (m := re.fullmatch(re.escape(prefix) + r"(\d+)", c))
        }
        found[prefix] = numbers
    missing = [p for p, numbers in found.items() if not numbers]
    if missing:
        raise ValueError(
            f"no columns '<prefix><beam_index>' for beam prefixes {missing}; available: {columns}"
        )
    return sorted(set.union(*found.values()))


def beams_from_columns(df: DataFrame, prefixes: Mapping[str, str]) -> Column:
    """Wide beam columns -> ordered ``array<struct>``.

    Entries without a sequence or with log-probability -inf are skipped, later ones
    move up; no entry at all gives NULL.
    """
    names = set(df.columns)

    def value(role: str, i: int) -> Column:
        name = f"{prefixes[role]}{i}"
        return _quoted(name) if name in names else F.lit(None).cast("string")

    def token_scores(text: Column) -> Column:
        named = F.regexp_replace(text, r"-?\binf\b|\bnan\b", "null")
        return F.from_json(F.when(text.contains("n"), named).otherwise(text), "array<double>")

    entries = [
        F.struct(
            value("sequence", i).alias("text"),
            value("log_probability", i).cast("double").alias("log_prob"),
            token_scores(value("token_log_probabilities", i)).alias("token_log_probs"),
        )
        for i in beam_indices(df.columns, prefixes)
    ]
    kept = F.filter(
        F.array(*entries),
        lambda e: F.coalesce(
            (e["text"] != "") & (e["log_prob"] > F.lit(float("-inf"))) & ~F.isnan(e["log_prob"]),
            F.lit(False),
        ),
    )
    shaped = F.transform(
        kept,
        lambda e: F.struct(
            P.leucine_to_isoleucine(P.tokenise(e["text"])).alias("sequence"),
            e["log_prob"].alias("log_prob"),
            e["token_log_probs"].alias("token_log_probs"),
        ),
    ).cast(BEAM_TYPE)
    return P.clean_tokens(shaped)


def shape_beam_csv(
    raw: DataFrame,
    spectrum_columns: list[str],
    column_mapping: Mapping[str, str] | None = None,
    beam_prefixes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rename, exponentiate, split tokens, nest beams; spectrum columns win clashes."""
    mapping = {**BEAM_CSV_COLUMNS, **(column_mapping or {})}
    prefixes = dict(beam_prefixes or {})
    beam_columns = [c for c in raw.columns if any(p in c for p in prefixes.values())]
    plain = [
        c
        for c in raw.columns
        if c not in beam_columns and (c == "spectrum_id" or c not in spectrum_columns)
    ]
    missing = [c for c in mapping.values() if c not in plain]
    if missing:
        raise ValueError(f"required prediction column(s) {missing} not found; available: {plain}")
    renamed = {mapping["predictions"], mapping["predictions_tokenised"], mapping["log_probability"]}
    tokens = F.split(_quoted(mapping["predictions_tokenised"]), ", ")
    out = [_quoted(c).alias(c) for c in plain if c not in renamed]
    out += [
        _quoted(mapping["predictions"]).alias("prediction_untokenised"),
        F.filter(tokens, lambda t: t != "").alias("prediction"),
        S.probability_from_log(_quoted(mapping["log_probability"]).cast("double")).alias("confidence"),
    ]
    if prefixes:
        out.append(beams_from_columns(raw, prefixes).alias("beams"))
    return raw.select(*out)


def load_beam_csv(
    spark: SparkSession,
    spectra_path: str | list[str],
    predictions_path: str,
    beam_prefixes: Mapping[str, str] | None = BEAM_PREFIXES,
    column_mapping: Mapping[str, str] | None = None,
    remapping: Mapping[str, str] | None = BEAM_CSV_REMAPPING,
    add_index: bool = False,
    masses: Mapping[str, float] | None = None,
) -> DataFrame:
    if not predictions_path:
        raise ValueError("no prediction file given")
    spectra, has_labels = scan_spectra(spark, spectra_path, add_index=add_index)
    raw = scan_beam_csv(spark, predictions_path)
    predictions = shape_beam_csv(raw, spectra.columns, column_mapping, beam_prefixes)
    return finalise(join_spectra(predictions, spectra), has_labels, remapping, masses)


# --- mzTab ------------------------------------------------------------------


def scan_mztab(spark: SparkSession, path: str) -> DataFrame:
    """PSM section as string columns; the literal ``null`` becomes NULL."""
    check_suffix(path, (".mztab",))
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").startswith("PSH\t")).first()
    if header is None:
        raise ValueError(f"{path!r} has no PSM section")
    names = header[0].rstrip("\r").split("\t")[1:]
    line = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    cells = F.transform(F.split(line, "\t"), lambda cell: F.trim(cell))
    rows = lines.filter(F.col("value").startswith("PSM\t")).select(cells.alias("c"))

    def cell(i: int) -> Column:
        value = F.get("c", F.lit(i + 1))
        return F.when((value != "") & (value != "null"), value)

    return rows.select(*[cell(i).alias(n) for i, n in enumerate(names)])


def is_beam_engine(raw: DataFrame) -> bool:
    """TRUE when any ``search_engine`` cell names an engine with native beam scores."""
    if "search_engine" not in raw.columns:
        return False
    named = F.lit(False)
    for marker in BEAM_ENGINE_MARKERS:
        named = named | F.col("search_engine").contains(marker)
    return not raw.filter(named).isEmpty()  # stops at the first match


def shape_mztab(
    raw: DataFrame,
    experiment: Column,
    spectrum_columns: list[str],
    beam_engine: bool,
    column_mapping: Mapping[str, str] | None = None,
) -> DataFrame:
    mapping = {**MZTAB_COLUMNS, **(column_mapping or {})}
    for role in ("predictions", "confidence"):
        if mapping.get(role) is None:
            raise ValueError(f"no column configured for {role!r}; available: {sorted(raw.columns)}")
    require_columns(raw, ["spectra_ref", mapping["predictions"], mapping["confidence"]])
    tokens_column = mapping.get("token_scores")
    has_tokens = tokens_column is not None and tokens_column in raw.columns
    index = F.coalesce(
        F.col("_index"),
        F.raise_error(
            F.concat(F.lit("cannot parse spectrum index from spectra_ref "), F.col("spectra_ref"))
        ).cast("long"),
    )
    token_scores = (
        F.transform(F.split(_quoted(tokens_column), ","), lambda x: x.cast("double"))
        if has_tokens
        else F.lit(None).cast("array<double>")
    )
    used = {"spectra_ref", mapping["predictions"], mapping["confidence"], "sequence"}
    if has_tokens:
        used.add(tokens_column)
    rest = [
        c
        for c in raw.columns
        if c not in used and (c in ("index", "spectrum_id") or c not in spectrum_columns)
    ]
    shaped = raw.withColumn("_index", P.spectrum_index(F.col("spectra_ref"))).select(
        *[_quoted(c).alias(c) for c in rest],
        index.alias("index"),
        F.concat_ws(":", experiment, index.cast("string")).alias("spectrum_id"),
        _quoted(mapping["predictions"]).alias("prediction_untokenised"),
        _quoted(mapping["confidence"]).cast("double").alias("confidence"),
        token_scores.alias("token_scores"),
    )
    if beam_engine:
        shaped = in_range(shaped, "confidence", -1.0, 1.0, "PSM score")
        shaped = shaped.withColumn(
            "token_scores",
            F.when(
                F.exists("token_scores", lambda x: (x < 0) | (x > 1)),
                F.raise_error(F.lit("token scores must be probabilities in [0, 1]")).cast(
                    "array<double>"
                ),
            ).otherwise(F.col("token_scores")),
        )
    return shaped.withColumn("prediction", F.col("prediction_untokenised"))


def run_of(reference: Column, runs: list[str]) -> Column:
    """Experiment of a ``spectra_ref``: ``ms_run[k]`` is the k-th of several loaded runs.

    With a single run every reference means that one; otherwise a missing or unknown k fails
    the job that reads it.
    """
    if len(runs) == 1:
        return F.lit(runs[0])
    k = F.regexp_extract(reference, r"ms_run\[(\d+)\]", 1)
    named = F.get(F.array(*[F.lit(r) for r in runs]), F.when(k != "", k.cast("int") - 1))
    return F.coalesce(
        named,
        F.raise_error(
            F.concat(F.lit(f"{len(runs)} runs are loaded, none of them is meant by "), reference)
        ).cast("string"),
    )


def candidate_rank(score: str, tie: list[str]) -> list[Column]:
    """Ascending struct order: score descending, NULL scores last, then ``tie``."""
    s = F.col(score)
    return [s.isNull(), -s, *[F.col(t) for t in tie]]


def load_mztab(
    spark: SparkSession,
    spectra_path: str | list[str],
    predictions_path: str,
    load_beams: bool = False,
    column_mapping: Mapping[str, str] | None = None,
    remapping: Mapping[str, str] | None = MZTAB_REMAPPING,
    masses: Mapping[str, float] | None = None,
) -> DataFrame:
    """Top-scored PSM per spectrum, with all its candidates as beams on request.

    Best row and candidate list come from ONE grouped aggregation over the PSM rows, stored
    for the key checks and the join.
    """
    if not predictions_path:
        raise ValueError("no prediction file given")
    spectra, has_labels = scan_spectra(spark, spectra_path, row_order_ids=True)
    spectra = spectra.drop("index")
    raw = scan_mztab(spark, predictions_path)
    beam_engine = is_beam_engine(raw)
    if load_beams and not beam_engine:
        raise ValueError("load_beams needs an mzTab written by an engine with beam candidates")
    experiment = run_of(F.col("spectra_ref"), run_names(spark, spectra_path))
    shaped = finalise(
        shape_mztab(raw, experiment, spectra.columns, beam_engine, column_mapping), False, remapping
    )
    rank = F.struct(
        *[
            c.alias(f"k{i}")
            for i, c in enumerate(candidate_rank("confidence", ["prediction_untokenised"]))
        ]
    )
    payload = [c for c in shaped.columns if c != "spectrum_id"]
    aggregates = [F.min_by(F.struct(*payload), rank).alias("_top")]
    if load_beams:
        beam = F.struct(
            F.col("prediction").alias("sequence"),
            S.log_from_penalised(F.col("confidence")).alias("log_prob"),
            S.token_logs(F.col("token_scores")).alias("token_log_probs"),
        )
        entry = F.when(F.col("prediction").isNotNull(), F.struct(rank.alias("r"), beam.alias("b")))
        aggregates.append(F.array_sort(F.collect_list(entry)).alias("_all"))
    grouped = shaped.groupBy("spectrum_id").agg(*aggregates)
    columns = [F.col("spectrum_id"), F.col("_top.*")]
    if load_beams:
        beams = F.transform("_all", lambda e: e["b"]).cast(BEAM_TYPE)
        columns.append(P.clean_tokens(beams).alias("beams"))
    top = grouped.select(*columns)
    if beam_engine:
        top = top.withColumn("confidence", S.probability_from_penalised(F.col("confidence")))
    merged = join_spectra(
        scale.store(top), spectra, unique_predictions=True, known_unique=("spectra", "predictions")
    )
    return finalise(merged, has_labels, remapping, masses)


# --- title-keyed TSV --------------------------------------------------------


def scan_title_tsv(spark: SparkSession, path: str) -> DataFrame:
    check_suffix(path, (".tsv", ".txt"))
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    require_columns(raw, ["label", "prediction", "score"])
    return in_range(raw.withColumn("score", F.col("score").cast("double")), "score", 0, 1, "score")


def shape_title_tsv(
    raw: DataFrame,
    experiment: Column,
    spectrum_columns: list[str],
    nterm_mods: tuple[str, ...] = TITLE_TSV_NTERM_MODS,
) -> DataFrame:
    """Ids from trimmed labels, misplaced terminal mods dropped, spectrum columns win."""
    label = F.trim("label")
    label = F.when((label != "") & (label != "nan"), label)
    checked = F.coalesce(
        label, F.raise_error(F.lit("empty label value; it must equal the MGF TITLE")).cast("string")
    )
    kept = drop_where(raw, P.misplaced_terminal_mod(F.col("prediction"), nterm_mods))
    shaped = (
        kept.withColumn("label", checked)
        .withColumn("spectrum_id", F.concat_ws(":", experiment, F.col("label")))
        .withColumnRenamed("score", "confidence")
        .withColumn("prediction_untokenised", F.col("prediction"))
    )
    return shaped.drop(*[c for c in shaped.columns if c in spectrum_columns and c != "spectrum_id"])


def _runs_by_title(predictions: DataFrame, spectra: DataFrame) -> DataFrame:
    """Ids of predictions whose titles lie in several runs; a title has to name one spectrum."""
    check_unique(spectra, "title", "titles of several runs:")
    titles = spectra.select(F.col("title").alias("label"), F.col("spectrum_id").alias("_id"))
    found = scale.shuffle_join(predictions, titles, "label")
    return found.withColumn("spectrum_id", F.coalesce("_id", "label")).drop("_id")


def load_title_tsv(
    spark: SparkSession,
    spectra_path: str | list[str],
    predictions_path: str,
    remapping: Mapping[str, str] | None = TITLE_TSV_REMAPPING,
    nterm_mods: tuple[str, ...] = TITLE_TSV_NTERM_MODS,
    masses: Mapping[str, float] | None = None,
) -> DataFrame:
    if not predictions_path:
        raise ValueError("no prediction file given")
    spectra, has_labels = scan_spectra(spark, spectra_path, require_titles=True)
    raw = scan_title_tsv(spark, predictions_path)
    runs = run_names(spark, spectra_path)
    predictions = shape_title_tsv(raw, F.lit(runs[0]), spectra.columns, nterm_mods)
    if len(runs) > 1:
        predictions = _runs_by_title(predictions, spectra)
    merged = join_spectra(
        predictions, spectra, unique_predictions=True, known_unique=("spectra",)
    )
    require_rows(merged, "the join of labels to titles produced no rows")
    return finalise(merged, has_labels, remapping, masses)
