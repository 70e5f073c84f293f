"""Registered queries: NaN and NULL scores, several runs in one load, files that differ."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafdr.constants import CARBON_ISOTOPE_MASS_SHIFT
from spectrafdr.functions import peptides as P
from spectrafdr.functions import spectra as N
from spectrafdr.operators import diagnostics, evaluation, fdr
from spectrafdr.operators import features as E
from spectrafdr.operators.features import RetentionTime
from spectrafdr.sources import predictions, saved, spectra
from spectrafdr.workload import views as V
from spectrafdr.workload.fdr_queries import FILTERED, GRID, GRID_SQL, LABEL_FREE
from spectrafdr.workload.registry import query, rnd
from spectrafdr.workload.source_queries import _folder, _mgf_rows


def _sound(sql: str) -> str:
    """The same SQL over the rows whose score can be ranked."""
    out = sql.replace(V.PSM_SQL, V.GAPS_SQL)
    return out.replace("AS run FROM psm)", "AS run FROM sound)").replace("FROM psm JOIN", "FROM sound JOIN")


# --- scores that cannot be ranked -----------------------------------------------------


@query("fdr_filter_nan", _sound(FILTERED))
def fdr_filter_nan(spark, d):
    """Rows without a score enter neither the curve nor the kept rows."""
    rows = V.psm_with_gaps(spark, d).select("spectrum_id", "confidence")
    curve = fdr.fit_label_free(rows, "confidence")
    out = fdr.control_fdr(rows, "confidence", 0.25, curve, same_scores=True)
    return out.select(
        "spectrum_id", rnd("confidence"), rnd("psm_fdr"), rnd("psm_q_value"), rnd("psm_pep")
    )


@query(
    "yield_nan",
    f"""{_sound(LABEL_FREE)}, grid(threshold) AS (VALUES {GRID_SQL}),
        cut AS (SELECT threshold, min(score) AS c FROM grid LEFT JOIN curve ON fdr <= threshold GROUP BY 1)
        SELECT threshold, (SELECT count(*) FROM sound WHERE confidence >= cut.c) AS n_psms FROM cut""",
)
def yield_nan(spark, d):
    rows = V.psm_with_gaps(spark, d)
    curve = fdr.fit_label_free(rows, "confidence")
    return fdr.yield_at(rows, "confidence", fdr.cutoffs_at(curve, GRID)).select("threshold", "n_psms")


@query(
    "tail_nan",
    f"""WITH {V.GAPS_SQL} SELECT count(*) AS n_tail,
        round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) - avg(confidence), 6) AS stece_empirical
        FROM sound WHERE confidence >= 0.7::double""",
)
def tail_nan(spark, d):
    rows = V.psm_with_gaps(spark, d)
    return diagnostics.tail_error(rows, "confidence", "correct", 0.7).select("n_tail", rnd("stece_empirical"))


@query(
    "calibration_nan",
    f"""WITH {V.GAPS_SQL}
        SELECT cast(greatest(1, ceil(confidence * 20)) AS integer) AS bin, round(avg(confidence), 6) AS mean_score,
          round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END), 6) AS empirical_rate, count(*) AS n
        FROM sound GROUP BY 1""",
)
def calibration_nan(spark, d):
    out = evaluation.calibration_curve_width(V.psm_with_gaps(spark, d), "confidence", "correct", 20)
    return out.select("bin", rnd("mean_score"), rnd("empirical_rate"), "n")


# --- spectra ------------------------------------------------------------------------------


@query(
    "mgf_unsorted",
    """SELECT concat('scan=', vec_id) AS title, 1e2 AS lowest, 1e2 + 1e1 * (len(embedding) - 1) AS highest,
         round(list_sum(list_transform(range(1, len(embedding) + 1),
               lambda i: i * round(abs(embedding[i]::double), 6))), 3) AS weighted
       FROM embeddings""",
)
def mgf_unsorted(spark, d):
    """Peaks written from the highest m/z down come back in ascending order with their intensities."""
    path = f"{_folder(spark)}/run.mgf"
    rows = _mgf_rows(spark, d).withColumns(
        {c: F.reverse(c) for c in ("mz_array", "intensity_array")}
    )
    spectra.write_mgf_text(rows).write.text(path)
    out, _ = spectra.scan_spectra(spark, path, require_titles=True)
    weighted = F.transform("intensity_array", lambda x, i: x * (i + 1))
    return out.select(
        "title",
        F.element_at("mz_array", 1).alias("lowest"),
        F.element_at("mz_array", -1).alias("highest"),
        F.round(P.array_sum(weighted), 3).alias("weighted"),
    )


@query(
    "mgf_multi_run",
    """SELECT CASE WHEN vec_id % 3 = 0 THEN 'my run+1' ELSE 'other' END AS experiment_name, count(*) AS n,
         count(*) AS n_ids, 0::bigint AS low, count(*) - 1 AS high FROM embeddings GROUP BY 1""",
)
def mgf_multi_run(spark, d):
    """Two runs, one with letters that paths encode; the split size changes before use."""
    folder = _folder(spark)
    rows = _mgf_rows(spark, d).withColumn("_third", F.regexp_extract("title", r"(\d+)", 1).cast("long") % 3 == 0)
    spectra.write_mgf_text(rows.filter("_third")).write.text(f"{folder}/my run+1.mgf")
    spectra.write_mgf_text(rows.filter("NOT _third")).write.text(f"{folder}/other.mgf")
    out, _ = spectra.scan_spectra(spark, [f"{folder}/my run+1.mgf", f"{folder}/other.mgf"])
    return out.groupBy("experiment_name").agg(
        F.count("*").alias("n"), F.countDistinct("spectrum_id").alias("n_ids"),
        F.min("scan_number").alias("low"), F.max("scan_number").alias("high"),
    )


@query(
    "directory_of_datasets",
    """SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS experiment_name, count(*) AS n,
         count(*) AS n_ids FROM embeddings GROUP BY 1""",
)
def directory_of_datasets(spark, d):
    """A folder of data-set folders: each is one experiment."""
    folder = _folder(spark)
    rows = V.spectra(spark, d).drop("spectrum_id")
    rows.filter("vec_id % 2 = 0").repartition(3).write.parquet(f"{folder}/even.parquet")
    rows.filter("vec_id % 2 = 1").repartition(2).write.parquet(f"{folder}/odd.parquet")
    out, _ = spectra.scan_spectra(spark, folder, row_order_ids=True)
    return out.groupBy("experiment_name").agg(
        F.count("*").alias("n"), F.countDistinct("spectrum_id").alias("n_ids")
    )


@query(
    "mixed_schema_runs",
    """SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS experiment_name,
         CASE WHEN vec_id % 2 = 0 THEN 'PEPTIDE' END AS sequence,
         CASE WHEN vec_id % 2 = 1 THEN vec_id * 1.5::double END AS retention_time FROM embeddings""",
)
def mixed_schema_runs(spark, d):
    """Runs with different columns: the union, NULL where a run has none."""
    folder = _folder(spark)
    rows = V.spectra(spark, d).drop("spectrum_id", "label")
    rows.filter("vec_id % 2 = 0").withColumn("sequence", F.lit("PEPTIDE")).write.parquet(f"{folder}/a.parquet")
    rows.filter("vec_id % 2 = 1").withColumn("retention_time", F.col("vec_id") * 1.5).write.parquet(
        f"{folder}/b.parquet"
    )
    out, _ = spectra.scan_spectra(spark, [f"{folder}/a.parquet", f"{folder}/b.parquet"], add_index=True)
    return out.select("vec_id", "experiment_name", "sequence", "retention_time")


@query(
    "mztab_multi_run",
    """SELECT concat(CASE WHEN vec_id % 2 = 0 THEN 'first' ELSE 'second' END, ':', vec_id // 2) AS spectrum_id,
         vec_id, round((vec_id % 97) / 1e2, 6) AS confidence FROM embeddings""",
)
def mztab_multi_run(spark, d):
    """ms_run[k] of one mzTab file means the k-th of several loaded runs."""
    folder = _folder(spark)
    rows = V.table(spark, d, "embeddings").select("vec_id")
    for k, name in enumerate(("first", "second")):
        rows.filter(F.col("vec_id") % 2 == k).repartitionByRange(3, "vec_id").sortWithinPartitions(
            "vec_id"
        ).write.parquet(f"{folder}/{name}.parquet")
    psm = rows.select(
        F.concat_ws(
            "\t", F.lit("PSM"), F.lit("PEPTIDE"), F.lit("[MS, MS:1, any, 1.0]"),
            ((F.col("vec_id") % 97) / 100).cast("string"),
            F.concat(F.lit("ms_run["), F.col("vec_id") % 2 + 1, F.lit("]:index="), F.expr("vec_id div 2")),
        ).alias("value")
    )
    head = spark.range(1).select(
        F.lit("\t".join(["PSH", "sequence", "search_engine", "search_engine_score[1]", "spectra_ref"])).alias("value")
    )
    head.unionByName(psm).write.text(f"{folder}/psms.mztab")
    out = predictions.load_mztab(
        spark, [f"{folder}/first.parquet", f"{folder}/second.parquet"], f"{folder}/psms.mztab",
        column_mapping={"predictions": "sequence"},
    )
    return out.select("spectrum_id", "vec_id", rnd("confidence"))


@query(
    "feature_files_union",
    "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids, round(sum(value), 3) AS total FROM events",
)
def feature_files_union(spark, d):
    """Feature files with equal columns are one table."""
    folder = _folder(spark)
    rows = V.table(spark, d, "events").select("event_id", F.col("value").alias("confidence"), F.lit(True).alias("correct"))
    for k in range(2):
        rows.filter(F.col("event_id") % 2 == k).write.parquet(f"{folder}/part{k}.parquet")
    out, _ = saved.load_features(spark, [f"{folder}/part0.parquet", f"{folder}/part1.parquet"])
    return out.agg(
        F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"),
        F.round(F.sum("confidence"), 3).alias("total"),
    )


@query(
    "irt_global_second_set",
    """SELECT event_id, round(abs((2e0 * (event_id % 50) + 5) - (3e0 * (event_id % 50))), 6) AS irt_error FROM events""",
)
def irt_global_second_set(spark, d):
    """The regressor of rows without experiments is fitted once and kept for the next set."""
    letters = F.array(*[F.lit(a) for a in "GASPVTCIND"])
    rows = V.table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("s"), F.col("event_id")).alias("spectrum_id"),
        F.array(
            F.element_at(letters, (F.col("event_id") % 50 % 10 + 1).cast("int")),
            F.element_at(letters, (F.floor(F.col("event_id") % 50 / 10) + 1).cast("int")),
        ).alias("prediction"),
        (F.col("event_id") % 50).cast("double").alias("retention_time"),
        F.lit(0.5).alias("confidence"),
    )
    irt = rows.select(P.proforma(F.col("prediction")).alias("peptide"), "retention_time").distinct()
    first = irt.select("peptide", (F.col("retention_time") * 2 + 5).alias("irt"))
    second = irt.select("peptide", (F.col("retention_time") * 3).alias("irt"))
    feature = RetentionTime(first, train_fraction=1.0, learn_from_missing=True)
    feature(rows)
    feature.irt_table = second
    return feature(rows).select("event_id", rnd("irt_error"))


# --- peak matching: ppm tolerance, competing ions, isotopes -------------------------------


@query(
    "ion_match_ppm",
    f"""WITH {V.SPECTRUM_SQL}, {V.ION_SQL}, total AS (SELECT vec_id, sum(h) AS tot FROM spec GROUP BY 1),
        hit AS (SELECT *, abs(mz - (1e2 + 1e1 * i)) < mz * 20 / 1e6 AS ok FROM ion)
        SELECT concat('v:', vec_id) AS spectrum_id, round(avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END), 6) AS match_rate,
          round(sum(CASE WHEN ok THEN h ELSE 0e0 END) / any_value(tot), 6) AS match_intensity,
          count(*) FILTER (ok) AS n_matched
        FROM hit JOIN total USING (vec_id) GROUP BY vec_id""",
)
def ion_match_ppm(spark, d):
    """20 ppm: the same offset matches from m/z 250 on only."""
    rows = V.spectra(spark, d).join(E.ions_to_arrays(V.predicted_ions(spark, d)), "spectrum_id")
    matched = N.matched_ions(
        F.col("mz"), F.col("annotation"), F.col("mz_array"), F.col("intensity_array"), 20, "ppm"
    )
    return rows.select("spectrum_id", matched.alias("m")).select("spectrum_id", "m.*").select(
        "spectrum_id", rnd("match_rate"), rnd("match_intensity"), F.size("mz").cast("long").alias("n_matched")
    )


@query(
    "ion_match_conflicts",
    """WITH pair AS (
          SELECT vec_id, j, abs(embedding[2 * j + 1]::double) AS h0, abs(embedding[2 * j + 2]::double) AS h1,
            (vec_id + j) % 4 AS s
          FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 2)) AS j FROM embeddings))
        SELECT concat('v:', vec_id) AS spectrum_id, round(1e0 / 3, 6) AS match_rate,
          round(sum(h1 + CASE WHEN s = 1 THEN 0e0 ELSE h0 END) / sum(h0 + h1), 6) AS match_intensity,
          string_agg(CASE s WHEN 0 THEN concat('b', 2 * j + 2, '+1') WHEN 1 THEN concat('y', j + 1, '+1')
                     ELSE concat('b', 2 * j + 1, '+1') END, ',' ORDER BY j) AS annotations
        FROM pair GROUP BY vec_id""",
)
def ion_match_conflicts(spark, d):
    """Two ions want one peak, a third wants the isotope peak that the winner's envelope takes.

    Of every three ions the first one present wins: it takes the peak and its M+1, the others
    find nothing free. Without the first two the third takes the isotope peak itself.
    """
    base = V.table(spark, d, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("i", "e")
    )
    mz = F.expr("1e2 + 2e1 * (i div 2)") + F.col("i") % 2 * F.lit(CARBON_ISOTOPE_MASS_SHIFT)
    peaks = F.struct(mz.alias("mz"), F.abs(F.col("e").cast("double")).alias("h"))
    j = F.expr("cast(i div 2 AS bigint)")
    s = (F.col("vec_id") + j) % 4
    away = F.lit(5.0)
    first = F.when(s < 2, away).otherwise(F.lit(0.005))
    second = F.when(s == 1, away + 1).otherwise(F.lit(0.010))
    third = F.lit(CARBON_ISOTOPE_MASS_SHIFT + 0.005)
    ions = F.array(
        *[
            F.struct((F.lit(100.0) + 20.0 * j + shift).alias("mz"), F.concat(F.lit(kind), number, F.lit("+1")).alias("name"))
            for shift, kind, number in ((first, "b", 2 * j + 1), (second, "b", 2 * j + 2), (third, "y", j + 1))
        ]
    )
    rows = base.groupBy("vec_id").agg(  # 64 peaks each
        F.array_sort(F.collect_list(peaks)).alias("p"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("i") % 2 == 0, ions)))).alias("n"),
    )
    field = lambda c, f: F.transform(c, lambda x: x[f])
    matched = N.matched_ions(field("n", "mz"), field("n", "name"), field("p", "mz"), field("p", "h"), 0.02, "da")
    return rows.select("vec_id", matched.alias("m")).select(
        F.concat(F.lit("v:"), F.col("vec_id")).alias("spectrum_id"),
        F.round("m.match_rate", 6).alias("match_rate"), F.round("m.match_intensity", 6).alias("match_intensity"),
        F.array_join("m.annotations", ",").alias("annotations"),
    )
