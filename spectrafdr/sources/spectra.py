"""Spectrum scans: parquet, Arrow IPC, MGF; one file, a list of files or a folder."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrafdr.operators import scale
from spectrafdr.operators.filters import drop_empty_labels
from spectrafdr.operators.joins import duplicate_keys

FORMATS = ("parquet", "ipc", "mgf")
# Split tables up to this size are broadcast; a row is a path and two numbers.
MAX_SPLITS = 200_000
# Header keys of an MGF block and the columns they fill.
_MGF_KEYS = {
    "PEPMASS": "precursor_mz", "CHARGE": "precursor_charge", "RTINSECONDS": "retention_time",
    "SEQ": "sequence", "PEPTIDE_SEQUENCE": "sequence", "TITLE": "title",
}


def decoded(path: Column) -> Column:
    """A file path as Spark's metadata has it (URL-encoded), with its own letters again."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_stem(path: Column) -> Column:
    """File name without folder and extension: the default experiment name."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def run_names(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Experiment names of the runs that :func:`scan_spectra` reads for ``path``, in its order."""
    names = (p.rstrip("/").rsplit("/", 1)[-1] for p in expand_paths(spark, path))
    return [n.rsplit(".", 1)[0] if "." in n[1:] else n for n in names]


def expand_paths(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Files and data-set folders: a folder without a known extension stands for its members."""
    paths = [path] if isinstance(path, str) else list(path)
    if len(paths) == 1 and not paths[0].rstrip("/").lower().endswith(tuple("." + f for f in FORMATS)):
        return _list_folder(spark, paths[0], FORMATS) or paths
    return paths


def by_format(paths: list[str]) -> dict[str, list[str]]:
    """Paths grouped by file extension; an unknown extension is an error."""
    groups: dict[str, list[str]] = {}
    for path in paths:
        groups.setdefault(path.rstrip("/").rsplit(".", 1)[-1].lower(), []).append(path)
    unknown = sorted(set(groups) - set(FORMATS))
    if unknown:
        raise ValueError(f"unsupported spectrum format(s) {unknown}; supported: {FORMATS}")
    return groups


def _list_folder(spark: SparkSession, folder: str, endings: tuple[str, ...] | None) -> list[str]:
    """Members of a folder (files or data-set folders) by extension; names only, in order.

    ``None`` takes every visible file. A path that is no folder has no members.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path) or not system.getFileStatus(path).isDirectory():
        return []
    names = [status.getPath().toString() for status in system.listStatus(path)]
    if endings is None:
        return sorted(n for n in names if n.rsplit("/", 1)[-1][0] not in "._")
    return sorted(n for n in names if n.lower().endswith(tuple("." + e for e in endings)))


def dataset_stem(path: Column, kind: str) -> Column:
    """Name of the data set a physical file belongs to.

    ``/x/run1.mgf`` and every part file below a folder ``/x/run1.mgf`` are ``run1``.
    """
    named = F.regexp_extract(path, rf"/([^/]+)\.{kind}(/|$)", 1)
    return F.when(named != "", named).otherwise(file_stem(path))


def _earlier_rows(counts: DataFrame, order: list[str]) -> DataFrame:
    """Exclusive running count of ``_n`` inside each data set; one row per file or split.

    Stored, so that the counting scan runs once and not with every use of the source.
    """
    before = (
        Window.partitionBy("_dataset").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return scale.materialise(
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )


def _join_shifts(df: DataFrame, shifts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows keep their place while the counted shift table is small.

    A key is one file split, so its rows fit a task even when both sides shuffle.
    """
    small = shifts.count() <= MAX_SPLITS
    return df.join(F.broadcast(shifts) if small else shifts, keys, "left")


def number_splits(df: DataFrame, name: str) -> DataFrame:
    """Stored rows of ``df`` with their 0-based number inside each data set.

    A file split is one contiguous block of one task: a row's number is its offset inside
    the block plus the rows of the earlier blocks. Rows are stored together with their block
    and offset, and the block table is made from the stored rows, so both always agree,
    however files are split later. ``df`` carries ``_dataset, _file, _block``.
    """
    keys = ["_dataset", "_file", "_block"]
    numbered = scale.store(df.withColumn("_mid", F.monotonically_increasing_id()))
    blocks = numbered.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_mid").alias("_base"))
    shifts = _earlier_rows(blocks, ["_file", "_block"]).select(
        *keys, (F.col("_before") - F.col("_base")).alias("_shift")
    )
    shift = F.coalesce("_shift", F.raise_error(F.lit("a file split has no row count")).cast("long"))
    return (
        _join_shifts(numbered, shifts, keys)
        .withColumn(name, F.col("_mid") + shift)
        .drop("_mid", "_shift", "_block")
    )


def number_files(df: DataFrame, name: str) -> DataFrame:
    """As ``number_splits`` for sources that know the row number inside a file (``_local``)."""
    keys = ["_dataset", "_file"]
    files = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    shifts = _earlier_rows(files, ["_file"]).select(*keys, "_before")
    return (
        _join_shifts(df, shifts, keys)
        .withColumn(
            name,
            F.col("_local")
            + F.coalesce("_before", F.raise_error(F.lit("a file has no row count")).cast("long")),
        )
        .drop("_local", "_before")
    )


def sort_peaks(df: DataFrame) -> DataFrame:
    """Peaks in ascending m/z; peak matching searches in that order."""
    if not {"mz_array", "intensity_array"} <= set(df.columns):
        return df
    peaks = F.array_sort(
        F.arrays_zip(F.col("mz_array").alias("m"), F.col("intensity_array").alias("i"))
    )
    return df.withColumn("_peaks", peaks).withColumns(
        {
            "mz_array": F.transform("_peaks", lambda p: p["m"]),
            "intensity_array": F.transform("_peaks", lambda p: p["i"]),
        }
    ).drop("_peaks")


def scan_mgf(spark: SparkSession, paths: list[str], number: bool = True) -> DataFrame:
    """MGF ion blocks as rows.

    The text source splits files at the record delimiter, so large files are read
    by many tasks. Header columns that no block carries are left out, and an
    all-empty label column as well. ``scan_number`` is the 0-based order in the file, left
    out without ``number``. Numbered rows are parsed once and stored; the columns to leave
    out are then seen without reading the text again.
    """
    blocks = (
        spark.read.text(paths, lineSep="END IONS")
        .select(
            F.regexp_replace("value", "\r", "").alias("text"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            dataset_stem(decoded(F.col("_metadata.file_path")), "mgf").alias("_dataset"),
        )
        .filter(F.col("text").contains("BEGIN IONS"))
    )

    def header(key: str) -> Column:
        value = F.trim(F.regexp_extract("text", rf"(?m)^{key}=(.*)$", 1))
        return F.when(value != "", value)

    lines = F.filter(
        F.split("text", "\n"), lambda line: line.rlike(r"^\s*[0-9.]+(?:[eE][+-]?\d+)?\s+[0-9.]")
    )
    fields = F.transform(lines, lambda line: F.split(F.trim(line), r"\s+"))
    charge = F.regexp_extract(header("CHARGE"), r"(\d+)([+-]?)", 1)
    sign = F.regexp_extract(header("CHARGE"), r"(\d+)([+-]?)", 2)
    parsed = blocks.select(
        F.split(header("PEPMASS"), r"\s+")[0].cast("double").alias("precursor_mz"),
        F.when(charge != "", charge.cast("int") * F.when(sign == "-", -1).otherwise(1)).alias(
            "precursor_charge"
        ),
        header("RTINSECONDS").cast("double").alias("retention_time"),
        F.coalesce(header("SEQ"), header("PEPTIDE_SEQUENCE")).alias("sequence"),
        header("TITLE").alias("title"),
        F.transform(fields, lambda f: f[0].cast("double")).alias("mz_array"),
        F.transform(fields, lambda f: f[1].cast("double")).alias("intensity_array"),
        *[F.col("text").contains(f"{key}=").alias(f"_has_{key}") for key in _MGF_KEYS],
        "_dataset",
        "_file",
        "_block",
    )
    parsed = sort_peaks(parsed)
    if number:
        parsed = number_splits(parsed, "scan_number")
    seen = parsed.agg(*[F.max(f"_has_{key}").alias(key) for key in _MGF_KEYS]).first()
    empty = [c for c in set(_MGF_KEYS.values()) if not any(seen[k] for k, n in _MGF_KEYS.items() if n == c)]
    first = ["scan_number"] if number else []
    kept = [c for c in parsed.columns if c not in (*empty, *first) and not c.startswith("_has_")]
    return parsed.select(*first, *[c for c in kept if c not in ("_file", "_block")])


def scan_ipc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Arrow IPC files by runs of record batches (:class:`loaders.IpcSource`).

    Batches are found from footers and message headers, so numbering rows reads none, and a
    task decodes its own batches only. Columns are the union over all files; a file without
    one has NULLs there.
    """
    from spectrafdr.sources.loaders import register_sources

    register_sources(spark)
    files = [part for p in paths for part in (_list_folder(spark, p, None) or [_qualified(spark, p)])]
    read = spark.read.format("psm-ipc").option("paths", json.dumps(files)).load()
    return read.withColumnsRenamed({"file": "_file", "row_number": "_local"})


def _qualified(spark: SparkSession, name: str) -> str:
    """A path with the scheme of the file system that Spark finds it in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def scan_spectra(
    spark: SparkSession,
    path: str | list[str],
    add_index: bool = False,
    row_order_ids: bool = False,
    require_titles: bool = False,
) -> tuple[DataFrame, bool]:
    """(spectra, has_labels) from files or a folder.

    MGF rows and ``add_index`` rows get ``experiment_name`` (the file stem) and
    ``spectrum_id = experiment:scan_number`` (or the row index without scan
    numbers). ``row_order_ids`` always uses the row index; ``require_titles`` uses
    the MGF title, which then has to be present and unique.
    """
    paths = expand_paths(spark, path)
    frames = [
        _scan_format(spark, kind, files, add_index, row_order_ids, require_titles)
        for kind, files in sorted(by_format(paths).items())
    ]
    df = frames[0]
    for frame in frames[1:]:
        df = df.unionByName(frame, allowMissingColumns=True)
    return drop_empty_labels(df)


def _scan_format(
    spark: SparkSession,
    kind: str,
    paths: list[str],
    add_index: bool,
    row_order_ids: bool,
    require_titles: bool,
) -> DataFrame:
    if require_titles and kind != "mgf":
        raise ValueError("title keys need .mgf spectra")
    want_ids = kind == "mgf" or add_index or row_order_ids
    if kind == "mgf":
        df = scan_mgf(spark, paths, number=not require_titles)
    elif kind == "ipc":
        df = sort_peaks(scan_ipc(spark, paths))
        df = df.withColumn("_dataset", dataset_stem(F.col("_file"), kind))
    else:
        # Files of one load may differ in columns; a file without one has NULLs there.
        df = sort_peaks(spark.read.option("mergeSchema", "true").parquet(*paths))
        if want_ids:
            df = df.select(
                "*",
                F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.row_index").alias("_local"),
                dataset_stem(decoded(F.col("_metadata.file_path")), kind).alias("_dataset"),
            )
    if want_ids:
        if require_titles:
            _check_titles(df)
            key = F.col("title")
        elif "scan_number" in df.columns and (kind == "mgf" or not row_order_ids):
            key = F.col("scan_number")  # for MGF this is the row order
        else:
            df = number_files(df, "_number")
            key = F.col("_number")
        df = df.withColumn("experiment_name", F.col("_dataset"))
        df = df.withColumn(
            "spectrum_id", F.concat_ws(":", F.col("experiment_name"), key.cast("string"))
        )
    df = df.drop("_dataset", "_file", "_local", "_number")
    return df.drop("title") if kind == "mgf" and not require_titles else df


def _check_titles(df: DataFrame) -> None:
    if "title" not in df.columns:
        raise ValueError("keys from TITLE: no ion block of the MGF files has one")
    missing = df.filter(F.col("title").isNull()).count()
    if missing:
        raise ValueError(f"keys from TITLE: {missing} ion blocks have none")
    twice = [
        r[0]
        for r in duplicate_keys(
            df.select(F.concat_ws(":", "_dataset", "title").alias("k")), "k"
        )
        .limit(5)
        .collect()
    ]
    if twice:
        raise ValueError(f"keys from TITLE: used twice in one file: {twice}")


def write_mgf_text(df: DataFrame, label: str | None = None) -> DataFrame:
    """One MGF ion block per row as a ``value`` column, ready for ``write.text``."""
    peaks = F.array_join(
        F.transform(
            F.arrays_zip(F.col("mz_array").alias("m"), F.col("intensity_array").alias("i")),
            lambda p: F.concat_ws(" ", p["m"].cast("string"), p["i"].cast("string")),
        ),
        "\n",
    )
    head = [F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), "title")]
    head.append(F.concat(F.lit("PEPMASS="), F.col("precursor_mz").cast("string")))
    head.append(F.concat(F.lit("CHARGE="), F.col("precursor_charge").cast("string"), F.lit("+")))
    head.append(F.concat(F.lit("RTINSECONDS="), F.col("retention_time").cast("string")))
    if label:
        head.append(F.concat(F.lit("SEQ="), F.coalesce(F.col(label), F.lit(""))))
    return df.select(F.concat_ws("\n", *head, peaks, F.lit("END IONS")).alias("value"))
