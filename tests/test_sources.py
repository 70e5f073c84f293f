import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectrafdr.sources import predictions, saved, spectra

MGF = """BEGIN IONS
TITLE=scan 1
PEPMASS=400.5 1000.0
CHARGE=2+
RTINSECONDS=12.5
SEQ=PEPTLDE
100.0 10.0
200.5 20.0
END IONS

BEGIN IONS
TITLE=scan 2
PEPMASS=500.25
CHARGE=3+
RTINSECONDS=13.5
SEQ=PEPTIDK
110.0 1e2
END IONS
"""


def put(path, text):
    path.write_text(text)
    return str(path)


def test_mgf(spark, tmp_path):
    path = put(tmp_path / "run.mgf", MGF)
    df, labels = spectra.scan_spectra(spark, path)
    a, b = df.orderBy("scan_number").collect()
    assert labels and "title" not in df.columns
    assert (a["spectrum_id"], a["experiment_name"], a["scan_number"]) == ("run:0", "run", 0)
    assert (a["precursor_mz"], a["precursor_charge"], a["retention_time"]) == (400.5, 2, 12.5)
    assert a["mz_array"] == [100.0, 200.5] and b["intensity_array"] == [100.0]
    assert b["spectrum_id"] == "run:1" and b["sequence"] == "PEPTIDK"


def test_mgf_many_splits_keep_the_row_order(spark, tmp_path):
    blocks = "".join(
        f"BEGIN IONS\nTITLE=t{i}\nPEPMASS={i}.5\n100.0 1.0\nEND IONS\n" for i in range(200)
    )
    path = put(tmp_path / "big.mgf", blocks)
    put(tmp_path / "other.mgf", MGF)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        df = spectra.scan_mgf(spark, [path, str(tmp_path / "other.mgf")])
        assert df.rdd.getNumPartitions() > 5
        rows = df.filter("_dataset = 'big'").select("scan_number", "precursor_mz").collect()
        assert sorted(r["scan_number"] for r in rows) == list(range(200))
        assert all(r["precursor_mz"] == r["scan_number"] + 0.5 for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_mgf_optional_columns_and_titles(spark, tmp_path):
    path = put(tmp_path / "x.mgf", "BEGIN IONS\nPEPMASS=1.5\n10 1\nEND IONS\n")
    df, labels = spectra.scan_spectra(spark, path)
    assert not labels and "precursor_charge" not in df.columns and "sequence" not in df.columns
    with pytest.raises(ValueError, match="TITLE"):
        spectra.scan_spectra(spark, path, require_titles=True)
    twice = put(tmp_path / "y.mgf", MGF.replace("scan 2", "scan 1"))
    with pytest.raises(ValueError, match="unique"):
        spectra.scan_spectra(spark, twice, require_titles=True)
    with pytest.raises(ValueError, match="unsupported"):
        spectra.scan_spectra(spark, put(tmp_path / "z.mzml", "x"))


def test_parquet_and_ipc(spark, tmp_path):
    table = pa.table({"mz_array": [[1.0], [2.0], [3.0]], "sequence": ["AG", None, ""]})
    import pyarrow.parquet as pq

    pq.write_table(table, tmp_path / "e.parquet")
    df, labels = spectra.scan_spectra(spark, str(tmp_path / "e.parquet"))
    assert labels and "spectrum_id" not in df.columns
    df, _ = spectra.scan_spectra(spark, str(tmp_path / "e.parquet"), add_index=True)
    assert sorted(r[0] for r in df.select("spectrum_id").collect()) == ["e:0", "e:1", "e:2"]
    blank = table.set_column(1, "sequence", pa.array([None, "", " "]))
    with pa.OSFile(str(tmp_path / "f.ipc"), "wb") as sink, pa.ipc.new_file(sink, table.schema) as w:
        for batch in blank.to_batches(max_chunksize=1):
            w.write_batch(batch)
    df, labels = spectra.scan_spectra(spark, str(tmp_path / "f.ipc"), add_index=True)
    assert not labels and "sequence" not in df.columns
    got = {r["spectrum_id"]: r["mz_array"] for r in df.collect()}
    assert got == {"f:0": [1.0], "f:1": [2.0], "f:2": [3.0]}


def test_directory_of_experiments(spark, tmp_path):
    put(tmp_path / "a.mgf", MGF)
    put(tmp_path / "b.mgf", MGF)
    df, _ = spectra.scan_spectra(spark, str(tmp_path))
    assert sorted(r[0] for r in df.select("spectrum_id").collect()) == ["a:0", "a:1", "b:0", "b:1"]
    spark.range(1).selectExpr("array(1e0) AS mz_array").toPandas().to_parquet(tmp_path / "c.parquet")
    both, labels = spectra.scan_spectra(spark, str(tmp_path), add_index=True)
    assert labels and both.filter("experiment_name = 'c'").first()["spectrum_id"] == "c:0"
    assert both.count() == 5


BEAM_CSV = """spectrum_id,predictions,predictions_tokenised,log_probs,precursor_mz,predictions_beam_0,predictions_beam_1,predictions_beam_2,predictions_log_probability_beam_0,predictions_log_probability_beam_1,predictions_log_probability_beam_2,predictions_token_log_probabilities_beam_0,predictions_token_log_probabilities_beam_1,predictions_token_log_probabilities_beam_2
run:0,PEPTLDE,"P, E, P, T, L, D, E",-0.5,9,PEPTLDE,,PEP,-0.5,-1.0,-2.0,"[-0.1, -0.2]",,"[-1.0]"
run:1,M(ox)K,"M(ox), K",,9,M(ox)K,K,,-inf,,-3.0,,,
"""


def test_beam_csv(spark, tmp_path):
    mgf = put(tmp_path / "run.mgf", MGF)
    csv = put(tmp_path / "preds.csv", BEAM_CSV)
    a, b = predictions.load_beam_csv(spark, mgf, csv).orderBy("spectrum_id").collect()
    assert a["prediction"] == list("PEPTIDE") and a["confidence"] == pytest.approx(0.60653066)
    assert a["precursor_mz"] == 400.5  # the spectrum wins the clash
    assert [x["sequence"] for x in a["beams"]] == [list("PEPTIDE"), list("PEP")]
    assert a["beams"][0]["token_log_probs"] == [-0.1, -0.2]
    assert a["correct"] and a["num_matches"] == 7 and a["valid_prediction"]
    assert b["prediction"] == ["M[UNIMOD:35]", "K"] and not b["valid_prediction"]  # no score
    assert b["beams"] is None and not b["correct"]


def test_beam_csv_errors(spark, tmp_path):
    mgf = put(tmp_path / "run.mgf", MGF)
    with pytest.raises(ValueError, match="unsupported prediction file"):
        predictions.load_beam_csv(spark, mgf, str(tmp_path / "x.tsv"))
    orphan = put(tmp_path / "o.csv", BEAM_CSV.replace("run:1", "run:7"))
    with pytest.raises(ValueError, match="no spectrum for"):
        predictions.load_beam_csv(spark, mgf, orphan)
    with pytest.raises(ValueError, match="beam prefixes"):
        predictions.load_beam_csv(
            spark, mgf, put(tmp_path / "p.csv", BEAM_CSV), {"sequence": "absent_"}
        )
    with pytest.raises(ValueError, match="required prediction column"):
        predictions.load_beam_csv(
            spark, mgf, str(tmp_path / "p.csv"), column_mapping={"log_probability": "lp"}
        )
    plain = predictions.load_beam_csv(spark, mgf, str(tmp_path / "p.csv"), beam_prefixes=None)
    assert "beams" not in plain.columns


MZTAB = """MTD\tmzTab-version\t1.0.0
PSH\tsequence\tsearch_engine\tsearch_engine_score[1]\tspectra_ref\topt_ms_run[1]_proforma\topt_ms_run[1]_aa_scores
PSM\tPEP\t[MS, MS:1003281, Casanovo, 4.0]\t-0.2\tms_run[1]:index=0\tPEPTIDK\t0.9,0.8
PSM\tPEP\t[MS, MS:1003281, Casanovo, 4.0]\t0.7\tms_run[1]:index=0\tPEPTLDE\t0.5,0.0
PSM\tPEP\t[MS, MS:1003281, Casanovo, 4.0]\t0.4\tms_run[1]:index=1\tM[Oxidation]K\tnull
"""


def test_mztab(spark, tmp_path):
    mgf = put(tmp_path / "run.mgf", MGF)
    tab = put(tmp_path / "x.mztab", MZTAB)
    a, b = predictions.load_mztab(spark, mgf, tab, load_beams=True).orderBy("index").collect()
    assert a["prediction"] == list("PEPTIDE") and a["confidence"] == 0.7 and a["correct"]
    assert [x["sequence"] for x in a["beams"]] == [list("PEPTIDE"), list("PEPTIDK")]
    assert a["beams"][1]["log_prob"] == pytest.approx(-0.2231435)  # ln(0.8)
    assert a["beams"][0]["token_log_probs"][1] == pytest.approx(-23.02585)
    assert b["prediction"] == ["M[UNIMOD:35]", "K"] and b["beams"][0]["token_log_probs"] is None
    other = put(tmp_path / "y.mztab", MZTAB.replace("MS:1003281, Casanovo", "MS:1, Other"))
    with pytest.raises(ValueError, match="load_beams"):
        predictions.load_mztab(spark, mgf, other, load_beams=True)
    assert predictions.load_mztab(spark, mgf, other).count() == 2
    with pytest.raises(Exception, match="PSM score must be in"):
        predictions.load_mztab(spark, mgf, put(tmp_path / "z.mztab", MZTAB.replace("0.7", "1.7"))).collect()
    with pytest.raises(Exception, match="spectra_ref"):
        predictions.load_mztab(spark, mgf, put(tmp_path / "w.mztab", MZTAB.replace("index=1", "scan=1"))).collect()
    with pytest.raises(ValueError, match="missing column"):
        predictions.load_mztab(spark, mgf, tab, column_mapping={"confidence": "absent"})


TSV = "label\tprediction\tcharge\tscore\nscan 1\tPEPTIDE\t2\t0.9\n scan 2 \tPEP[+42.011]TIDE\t2\t0.5\n"


def test_title_tsv(spark, tmp_path):
    mgf = put(tmp_path / "run.mgf", MGF)
    out = predictions.load_title_tsv(spark, mgf, put(tmp_path / "p.tsv", TSV)).collect()
    assert len(out) == 1 and out[0]["spectrum_id"] == "run:scan 1" and out[0]["correct"]
    with pytest.raises(Exception, match=r"score must be in \[0, 1\]"):
        predictions.load_title_tsv(spark, mgf, put(tmp_path / "q.tsv", TSV.replace("0.9", "1.9"))).collect()
    with pytest.raises(Exception, match="label"):
        predictions.load_title_tsv(spark, mgf, put(tmp_path / "r.tsv", TSV.replace("scan 1", " "))).collect()
    with pytest.raises(ValueError, match="unique"):
        predictions.load_title_tsv(spark, mgf, put(tmp_path / "s.tsv", TSV + "scan 1\tPEP\t2\t0.1\n"))


def test_fasta(spark, tmp_path):
    path = put(tmp_path / "p.fasta", ">prot1 a>b\nMKLLP\nEPTLDE\n>prot2\n\n>prot3\r\nAAA\r\n")
    rows = {r["header"]: r["sequence"] for r in saved.scan_fasta(spark, path).collect()}
    assert rows == {"prot1 a>b": "MKLLPEPTLDE", "prot3": "AAA"}


def test_saved_metadata_csv(spark, tmp_path):
    text = (
        'prediction,confidence,mz_array,intensity_array,sequence\n'
        'PEPTLDE,0.5,"[100.0, 200.0, 300.0]","[100.   200.\n 300. ]",\n'
    )
    row = saved.load_saved(spark, put(tmp_path / "metadata.csv", text)).first()
    assert row["mz_array"] == [100.0, 200.0, 300.0] == row["intensity_array"]
    assert row["prediction"] == list("PEPTIDE") and "sequence" not in row.asDict()


def test_export_and_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("s", ["[UNIMOD:1]", "A"], 0.9, 0.1, 0.1, 0.1, 7.0, [1.0])],
        "spectrum_id string, prediction array<string>, confidence double, psm_fdr double, "
        "psm_q_value double, psm_pep double, extra double, mz_array array<double>",
    )
    out = saved.export_metadata(rows)
    assert out.first()["prediction"] == "[UNIMOD:1]-A" and "valid_prediction" not in out.columns
    saved.save_predictions(rows, str(tmp_path / "out"), "confidence")
    meta = spark.read.csv(str(tmp_path / "out/metadata.csv"), header=True)
    preds = spark.read.csv(str(tmp_path / "out/preds_and_fdr_metrics.csv"), header=True)
    assert meta.columns == ["spectrum_id", "extra", "mz_array"]
    assert preds.columns == ["spectrum_id", "prediction", "confidence", "psm_fdr", "psm_q_value", "psm_pep"]
    saved.save_dataset(rows, str(tmp_path / "d"))
    assert saved.load_saved(spark, str(tmp_path / "d")).first()["valid_prediction"]
    with pytest.raises(ValueError, match="unsupported output"):
        saved.write_table(rows, str(tmp_path / "x.json"))
    with pytest.raises(ValueError, match="raw strings"):
        saved.export_metadata(rows.withColumn("prediction", F.lit("A")))


def test_feature_files(spark, tmp_path):
    a = spark.createDataFrame([(0.5, 1.0, True, "x")], "confidence double, f double, correct boolean, name string")
    a.write.parquet(str(tmp_path / "f"))
    df, columns = saved.load_features(spark, str(tmp_path / "f"))
    assert columns == ["f"] and df.columns == ["confidence", "f", "correct"]
    a.drop("correct").write.parquet(str(tmp_path / "g"))
    with pytest.raises(ValueError, match="missing column"):
        saved.load_features(spark, str(tmp_path / "g"))


def _spectra(spark, n, first=0):
    rows = [(f"t{i}", 400.0 + i, 2, 1.0 * i, [300.0, 100.0, 200.0], [3.0, 1.0, 2.0]) for i in range(first, first + n)]
    return spark.createDataFrame(
        rows,
        "title string, precursor_mz double, precursor_charge int, retention_time double, "
        "mz_array array<double>, intensity_array array<double>",
    )


def test_no_row_is_lost_when_the_split_size_changes(spark, tmp_path):
    path = str(tmp_path / "run.mgf")
    spectra.write_mgf_text(_spectra(spark, 3000).repartition(3)).write.text(path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        out, _ = spectra.scan_spectra(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        found = out.select("scan_number", "spectrum_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(r.scan_number for r in found) == list(range(3000))
    assert len({r.spectrum_id for r in found}) == 3000


def test_peaks_come_sorted_from_every_format(spark, tmp_path):
    rows = _spectra(spark, 3)
    spectra.write_mgf_text(rows).write.text(str(tmp_path / "a.mgf"))
    rows.write.parquet(str(tmp_path / "b.parquet"))
    for name in ("a.mgf", "b.parquet"):
        out, _ = spectra.scan_spectra(spark, str(tmp_path / name))
        got = {(tuple(r.mz_array), tuple(r.intensity_array)) for r in out.collect()}
        assert got == {((100.0, 200.0, 300.0), (1.0, 2.0, 3.0))}


def test_experiment_names_keep_their_letters(spark, tmp_path):
    for name in ("my run", "a+b%c"):
        spectra.write_mgf_text(_spectra(spark, 2)).write.text(str(tmp_path / f"{name}.mgf"))
    out, _ = spectra.scan_spectra(spark, str(tmp_path))
    assert {r[0] for r in out.select("experiment_name").distinct().collect()} == {"my run", "a+b%c"}
    assert spectra.run_names(spark, str(tmp_path)) == ["a+b%c", "my run"]


def test_titles_of_several_runs(spark, tmp_path):
    for k, name in enumerate(("r1", "r2")):
        spectra.write_mgf_text(_spectra(spark, 3, 3 * k)).write.text(str(tmp_path / f"{name}.mgf"))
    paths = [str(tmp_path / "r1.mgf"), str(tmp_path / "r2.mgf")]
    preds = spark.createDataFrame([("t1", "AC", 0.5), ("t4", "CA", 0.7)], "label string, prediction string, score double")
    preds.coalesce(1).write.csv(str(tmp_path / "p.tsv"), sep="\t", header=True)
    out = predictions.load_title_tsv(spark, paths, str(tmp_path / "p.tsv"))
    assert {r.spectrum_id for r in out.collect()} == {"r1:t1", "r2:t4"}


def test_unknown_run_numbers_fail(spark, tmp_path):
    frame = spark.createDataFrame([("ms_run[3]:index=1",)], "ref string")
    with pytest.raises(Exception, match="2 runs are loaded"):
        frame.select(predictions.run_of(F.col("ref"), ["a", "b"])).collect()
    assert frame.select(predictions.run_of(F.col("ref"), ["only"])).first()[0] == "only"


def test_ipc_files_with_different_columns(spark, tmp_path):
    import pyarrow as pa

    for name, table in (("a", pa.table({"scan_number": [1, 2], "extra": ["x", "y"]})), ("b", pa.table({"scan_number": [3]}))):
        with pa.ipc.new_file(str(tmp_path / f"{name}.ipc"), table.schema) as writer:
            writer.write_table(table)
    out, _ = spectra.scan_spectra(spark, str(tmp_path), add_index=True)
    assert {(r.spectrum_id, r.extra) for r in out.collect()} == {("a:1", "x"), ("a:2", "y"), ("b:3", None)}


def test_csv_round_trip_keeps_types(spark, tmp_path):
    rows = spark.createDataFrame(
        [("e:1", 0.5, 1.25, True, "AC", "7"), ("e:2", 0.25, None, False, "CA", "8")],
        "spectrum_id string, confidence double, margin double, is_missing_x boolean, prediction string, title string",
    )
    saved.write_table(rows, str(tmp_path / "m.csv"))
    kinds = dict(saved.load_saved(spark, str(tmp_path / "m.csv")).dtypes)
    assert (kinds["margin"], kinds["is_missing_x"], kinds["title"]) == ("double", "boolean", "string")


def test_feature_files_that_differ_are_refused(spark, tmp_path):
    one = spark.createDataFrame([(0.5, True, 1.0)], "confidence double, correct boolean, f1 double")
    one.write.parquet(str(tmp_path / "a.parquet"))
    one.withColumn("f2", F.lit(2.0)).write.parquet(str(tmp_path / "b.parquet"))
    with pytest.raises(ValueError, match="f2"):
        saved.load_features(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")])
