"""Registered queries: file formats. Spark first writes the tables in the format, then loads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafdr.functions import peptides as P
from spectrafdr.operators import scale
from spectrafdr.operators.features import RetentionTime
from spectrafdr.sources import predictions, saved, spectra
from spectrafdr.workload import views as V
from spectrafdr.workload.feature_queries import _IRT, _irt_inputs
from spectrafdr.workload.registry import query, rnd


def _folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    return f"{scale.shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


# --- MGF ----------------------------------------------------------------------------


def _mgf_rows(spark, d) -> DataFrame:
    return V.spectra(spark, d).select(
        F.concat(F.lit("scan="), F.col("vec_id")).alias("title"),
        (F.lit(400.0) + F.col("vec_id") / 4).alias("precursor_mz"),
        F.expr("cast(1 + vec_id % 4 AS int)").alias("precursor_charge"),
        (F.col("vec_id") * 1.5).alias("retention_time"),
        F.when(F.col("vec_id") % 3 > 0, "PEPTIDE").alias("sequence"),
        "mz_array",
        F.transform("intensity_array", lambda x: F.round(x, 6)).alias("intensity_array"),
    )


@query(
    "mgf_scan",
    """SELECT concat('scan=', vec_id) AS title, 4e2 + vec_id / 4e0 AS precursor_mz,
         cast(1 + vec_id % 4 AS integer) AS precursor_charge, vec_id * 1.5::double AS retention_time,
         CASE WHEN vec_id % 3 > 0 THEN 'PEPTIDE' END AS sequence, 64 AS n_peaks,
         round(list_sum(list_transform(embedding, lambda e: round(abs(e::double), 6))), 3) AS total
       FROM embeddings""",
)
def mgf_scan(spark, d):
    path = f"{_folder(spark)}/run.mgf"
    spectra.write_mgf_text(_mgf_rows(spark, d), "sequence").write.text(path)
    out = spectra.scan_mgf(spark, [path])
    return out.select(
        "title", "precursor_mz", "precursor_charge", "retention_time", "sequence",
        F.size("mz_array").cast("long").alias("n_peaks"),
        F.round(P.array_sum(F.col("intensity_array")), 3).alias("total"),
    )


@query(
    "mgf_row_numbers",
    """SELECT 'run' AS experiment_name, count(*) AS n, count(*) AS n_ids, 0::bigint AS low,
         count(*) - 1 AS high FROM embeddings""",
)
def mgf_row_numbers(spark, d):
    """Scan numbers are dense over all splits of a data set."""
    path = f"{_folder(spark)}/run.mgf"
    spectra.write_mgf_text(_mgf_rows(spark, d).repartition(4)).write.text(path)
    out, _ = spectra.scan_spectra(spark, path)
    return out.groupBy("experiment_name").agg(
        F.count("*").alias("n"),
        F.countDistinct("spectrum_id").alias("n_ids"),
        F.min("scan_number").alias("low"),
        F.max("scan_number").alias("high"),
    )


# --- parquet / Arrow IPC folders ---------------------------------------------------------


@query(
    "parquet_row_ids",
    "SELECT 'run' AS experiment_name, count(*) AS n, count(*) AS n_ids FROM embeddings",
)
def parquet_row_ids(spark, d):
    path = f"{_folder(spark)}/run.parquet"
    V.spectra(spark, d).drop("spectrum_id").repartition(4).write.parquet(path)
    out, _ = spectra.scan_spectra(spark, path, row_order_ids=True)
    return out.groupBy("experiment_name").agg(
        F.count("*").alias("n"), F.countDistinct("spectrum_id").alias("n_ids")
    )


@query(
    "ipc_scan",
    """SELECT label, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda e: abs(e::double)))), 3)
       AS total FROM embeddings GROUP BY 1""",
)
def ipc_scan(spark, d):
    folder = _folder(spark)
    rows = V.spectra(spark, d).select("vec_id", "label", "intensity_array")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        table = list(batches)
        if not table:
            return
        uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        system, inner = fs.FileSystem.from_uri(uri)
        system.create_dir(inner, recursive=True)
        name = f"{inner}/run{TaskContext.get().partitionId()}.ipc"
        with system.open_output_stream(name) as sink, pa.ipc.new_file(sink, table[0].schema) as out:
            for batch in table:
                out.write_batch(batch)
        yield pa.RecordBatch.from_pydict({"path": [name]})

    rows.repartition(4).mapInArrow(write, "path string").write.format("noop").mode(
        "overwrite"
    ).save()
    out, _ = spectra.scan_spectra(spark, folder)
    return out.groupBy("label").agg(
        F.count("*").alias("n"),
        F.round(F.sum(P.array_sum(F.col("intensity_array"))), 3).alias("total"),
    )


# --- beam CSV -----------------------------------------------------------------------------


def _label(column: str) -> str:
    return f"CASE WHEN l_orderkey % 2 = 0 THEN {column} ELSE reverse({column}) END"


@query(
    "beam_csv_load",
    f"""WITH {V.BEAM_SQL}, x AS (SELECT *, {_label('s[1]')} AS lab FROM beam)
        SELECT concat('o:', l_orderkey) AS spectrum_id, round(p[1], 6) AS confidence,
          replace(s[1], 'L', 'I') AS prediction, len(p) AS n_beams,
          round(p[2], 6) AS second, replace(s[2], 'L', 'I') AS second_sequence,
          replace(s[1], 'L', 'I') = replace(lab, 'L', 'I') AS same
        FROM x""",
)
def beam_csv_load(spark, d):
    """Spectra table + wide CSV with beam columns -> PSM rows with nested beams."""
    folder = _folder(spark)
    rows = scale.store(V.beams(spark, d).select(
        "l_orderkey",
        "beams",
        F.array_join(F.get("beams", F.lit(0))["sequence"], "").alias("top"),
    ))  # read three times
    rows.select(
        F.concat(F.lit("o:"), F.col("l_orderkey")).alias("spectrum_id"),
        F.expr(_label("top")).alias("sequence"),
        F.lit(500.0).alias("precursor_mz"),
    ).write.parquet(f"{folder}/spectra.parquet")
    wide = [
        F.concat(F.lit("o:"), F.col("l_orderkey")).alias("spectrum_id"),
        F.col("top").alias("predictions"),
        F.array_join(F.get("beams", F.lit(0))["sequence"], ", ").alias("predictions_tokenised"),
        F.get("beams", F.lit(0))["log_prob"].alias("log_probs"),
    ]
    width = rows.agg(F.max(F.size("beams"))).first()[0] or 0
    for i in range(width):
        beam = F.get("beams", F.lit(i))
        wide += [
            F.array_join(beam["sequence"], "").alias(f"predictions_beam_{i}"),
            beam["log_prob"].alias(f"predictions_log_probability_beam_{i}"),
            F.to_json(F.transform(beam["sequence"], lambda t: F.lit(-0.5))).alias(
                f"predictions_token_log_probabilities_beam_{i}"
            ),
        ]
    rows.select(*wide).write.csv(f"{folder}/preds.csv", header=True, quote='"', escape='"')
    out = predictions.load_beam_csv(spark, f"{folder}/spectra.parquet", f"{folder}/preds.csv")
    second = F.get("beams", F.lit(1))
    # Letters read left to right equal exactly when the peptide equals its label.
    return out.select(
        "spectrum_id", rnd("confidence"),
        F.array_join("prediction", "").alias("prediction"),
        F.size("beams").cast("long").alias("n_beams"),
        F.round(F.exp(second["log_prob"]), 6).alias("second"),
        F.array_join(second["sequence"], "").alias("second_sequence"),
        (F.array_join("sequence", "") == F.array_join("prediction", "")).alias("same"),
    )


# --- mzTab ----------------------------------------------------------------------------------


@query(
    "mztab_load",
    f"""WITH {V.CANDIDATE_SQL}, score AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN prob - 1 ELSE prob END AS s
          FROM cand),
        r AS (SELECT l_orderkey, list(s ORDER BY s DESC, seq) AS s, list(seq ORDER BY s DESC, seq) AS q
              FROM score GROUP BY 1)
        SELECT o_orderkey, concat('run:', o_orderkey) AS spectrum_id, len(s) AS n_beams,
          round(greatest(CASE WHEN s[1] < 0 THEN s[1] + 1 ELSE s[1] END, 1e-10), 6) AS confidence,
          replace(q[1], 'L', 'I') AS prediction, replace(q[-1], 'L', 'I') AS last_candidate
        FROM orders JOIN r ON o_orderkey = l_orderkey""",
)
def mztab_load(spark, d):
    """Spectra in file order (orders by key) + an mzTab with all lines as PSMs."""
    folder = _folder(spark)
    orders = V.table(spark, d, "orders").select("o_orderkey")
    orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(
        f"{folder}/run.parquet"
    )
    cand = V.candidates(spark, d)
    known = cand.join(orders, cand.l_orderkey == orders.o_orderkey, "left_semi")
    score = F.when(F.col("l_linenumber") % 3 == 0, F.col("prob") - 1).otherwise(F.col("prob"))
    psm = known.select(
        F.concat_ws(
            "\t",
            F.lit("PSM"),
            F.col("seq"),
            F.lit("[MS, MS:1003281, Casanovo, 4.0]"),
            score.cast("string"),
            F.concat(F.lit("ms_run[1]:index="), F.col("l_orderkey")),
            F.array_join(F.transform(P.tokenise(F.col("seq")), lambda t: F.lit("0.5")), ","),
        ).alias("value")
    )
    head = spark.range(1).select(
        F.concat_ws(
            "\t", F.lit("PSH"), F.lit("sequence"), F.lit("search_engine"),
            F.lit("search_engine_score[1]"), F.lit("spectra_ref"), F.lit("opt_ms_run[1]_aa_scores"),
        ).alias("value")
    )
    head.unionByName(psm).write.text(f"{folder}/psms.mztab")
    out = predictions.load_mztab(
        spark, f"{folder}/run.parquet", f"{folder}/psms.mztab", load_beams=True,
        column_mapping={"predictions": "sequence"},
    )
    last = F.element_at("beams", -1)
    return out.select(
        "o_orderkey", "spectrum_id", F.size("beams").cast("long").alias("n_beams"),
        rnd("confidence"), F.array_join("prediction", "").alias("prediction"),
        F.array_join(last["sequence"], "").alias("last_candidate"),
    )


# --- title-keyed TSV ---------------------------------------------------------------------------


@query(
    "title_tsv_load",
    """SELECT concat('run:scan=', vec_id) AS spectrum_id, concat('scan=', vec_id) AS title,
         round((vec_id % 101) / 1e2, 6) AS confidence, vec_id % 3 > 0 AS valid_sequence,
         vec_id % 15 > 0 AND vec_id % 3 > 0 AND vec_id % 5 > 0 AS correct
       FROM embeddings WHERE vec_id % 7 > 0""",
)
def title_tsv_load(spark, d):
    """MGF titles joined to TSV labels; rows with a misplaced terminal mod are dropped."""
    folder = _folder(spark)
    spectra.write_mgf_text(_mgf_rows(spark, d), "sequence").write.text(f"{folder}/run.mgf")
    prediction = (
        F.when(F.col("vec_id") % 7 == 0, "PEP[+42.011]TIDE")
        .when(F.col("vec_id") % 5 == 0, "PEPTIDK")
        .otherwise("PEPTLDE")
    )
    V.spectra(spark, d).select(
        F.concat(F.lit("scan="), F.col("vec_id")).alias("label"),
        prediction.alias("prediction"),
        F.lit(2).alias("charge"),
        F.expr("(vec_id % 101) / 1e2").alias("score"),
    ).write.csv(f"{folder}/preds.tsv", sep="\t", header=True)
    out = predictions.load_title_tsv(spark, f"{folder}/run.mgf", f"{folder}/preds.tsv")
    return out.select("spectrum_id", "title", rnd("confidence"), "valid_sequence", "correct")


# --- FASTA, saved data sets, feature tables, regressors ------------------------------------------


@query(
    "fasta_scan",
    f"""WITH {V.PROTEIN_SQL} SELECT concat('doc', doc_id) AS header, length(hay) AS n_letters,
        md5(hay) AS digest FROM prot WHERE length(hay) > 0""",
)
def fasta_scan(spark, d):
    """Proteins wrapped at 60 letters, read back per record."""
    path = f"{_folder(spark)}/proteome.fasta"
    V.proteins(spark, d).select(
        F.concat(
            F.lit(">doc"), F.col("doc_id"), F.lit("\n"),
            F.regexp_replace("sequence", "(.{60})", "$1\n"),
        ).alias("value")
    ).write.text(path)
    out = saved.scan_fasta(spark, path)
    hay = F.translate("sequence", "I", "L")
    return out.select(
        "header", F.length(hay).cast("long").alias("n_letters"), F.md5(hay).alias("digest")
    )


@query(
    "saved_dataset",
    f"""WITH {V.PART_SQL} SELECT p_partkey, replace(seq, 'L', 'I') AS prediction,
        round(precursor_mz, 4) AS precursor_mz FROM pep""",
)
def saved_dataset(spark, d):
    path = f"{_folder(spark)}/dataset"
    rows = V.part_peptides(spark, d).withColumn("confidence", F.lit(0.5))
    saved.save_dataset(rows, path)
    out = saved.load_saved(spark, path)
    return out.filter("valid_prediction").select(
        "p_partkey", F.array_join("prediction", "").alias("prediction"), rnd("precursor_mz", digits=4)
    )


@query(
    "saved_csv",
    """SELECT vec_id, 64 AS n, round(list_sum(list_transform(embedding, lambda e: round(abs(e::double), 6))), 4)
       AS total FROM embeddings""",
)
def saved_csv(spark, d):
    """Legacy CSV cells in array print form: ``[0.1 0.2]``."""
    path = f"{_folder(spark)}/metadata.csv"
    cell = F.concat(
        F.lit("["),
        F.array_join(F.transform("intensity_array", lambda x: F.round(x, 6).cast("string")), " "),
        F.lit("]"),
    )
    V.spectra(spark, d).select(
        "vec_id", F.lit("PEPTIDE").alias("prediction"), F.lit(0.5).alias("confidence"),
        cell.alias("intensity_array"),
    ).write.csv(path, header=True, quote='"', escape='"')
    out = saved.load_saved(spark, path)
    return out.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.size("intensity_array").cast("long").alias("n"),
        F.round(P.array_sum(F.col("intensity_array")), 4).alias("total"),
    )


@query(
    "feature_table",
    f"""WITH {V.PSM_SQL} SELECT round(confidence, 6) AS confidence, cast(user_id AS double) AS user_id,
        correct FROM psm""",
)
def feature_table(spark, d):
    path = f"{_folder(spark)}/features"
    saved.save_matrix(V.psm(spark, d), ["user_id"], path)
    out, columns = saved.load_features(spark, path)
    return out.select(rnd("confidence"), *columns, "correct")


@query(
    "pinned_regressors",
    f"""WITH {_IRT}, pin AS (SELECT * REPLACE (CASE WHEN experiment_name = 'click' THEN 1e0 ELSE slope END AS slope,
          CASE WHEN experiment_name = 'click' THEN 2e0 ELSE intercept END AS intercept) FROM reg)
        SELECT spectrum_id, round(abs(slope * retention_time + intercept - irt), 3) AS irt_error
        FROM row JOIN pin USING (experiment_name)""",
)
def pinned_regressors(spark, d):
    """A stored regressor is applied as is; the other experiments are fitted."""
    path = f"{_folder(spark)}/regressors"
    rows, irt = _irt_inputs(spark, d)
    fixed = rows.filter("experiment_name = 'click'").select(
        "experiment_name", F.lit(1.0).alias("slope"), F.lit(2.0).alias("intercept")
    ).distinct()
    saved.save_regressors(fixed, path)
    out = RetentionTime(irt, regressors=saved.load_regressors(spark, path))(rows)
    return out.select("spectrum_id", rnd("irt_error", digits=3))
