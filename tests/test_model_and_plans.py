import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafdr.operators import calibrator as C
from spectrafdr.operators import diagnostics, fdr, joins, proteome, scale, split
from spectrafdr.operators.features import CustomFeature, FeatureSet, SequenceLength
from spectrafdr.plans import jobs
from spectrafdr.sources import saved
from spectrafdr.streaming import scoring

# --- network --------------------------------------------------------------------


def fixed_model():
    model = C.ProbabilityCalibrator(["f1", "f2"], hidden_dims=(4,))
    model.mean, model.std = [0.5, 1.5, 0.2], [0.4, 1.0, 0.1]
    model.weights = [np.full((4, 3), 0.1), np.full(4, 0.2), np.full((1, 4), 0.3), np.full(1, 0.4)]
    return model


def golden_rows(spark):
    return spark.createDataFrame(
        [(0.9, 1.0, 0.1), (0.5, 2.0, 0.2), (0.1, 3.0, 0.3)], "confidence double, f1 double, f2 double"
    )


def test_golden_probabilities(spark, tmp_path):
    # Fixed values.
    want = [0.641067385673523, 0.6681877970695496, 0.6942363977432251]
    model = fixed_model()
    got = [r[0] for r in model.predict(golden_rows(spark)).select("calibrated_confidence").collect()]
    assert got == pytest.approx(want, abs=1e-6)
    shuffled = golden_rows(spark).select("f2", "confidence", "f1")
    again = [r[0] for r in model.predict(shuffled).select("calibrated_confidence").collect()]
    assert again == got
    model.save(spark, str(tmp_path / "m"))
    loaded = C.ProbabilityCalibrator.load(spark, str(tmp_path / "m"))
    assert loaded.feature_columns == ["f1", "f2"] and loaded.hidden_dims == (4,)
    assert [
        r[0] for r in loaded.predict(golden_rows(spark)).select("calibrated_confidence").collect()
    ] == got


def test_golden_logits():
    x = np.array([[0.9, 1, 0.1], [0.5, 2, 0.2], [0.1, 3, 0.3]])
    z, _ = C.forward(fixed_model().weights, x)
    # Fixed values.
    assert z.tolist() == pytest.approx([0.8799999952316284, 0.9640001058578491, 1.0480000972747803])


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    weights = C.init_weights([3, 5, 4, 1], 0)
    x, y = rng.normal(size=(6, 3)), rng.integers(0, 2, 6).astype(float)
    z, layers = C.forward(weights, x)
    grads = C.gradients(weights, layers, (C.sigmoid(z) - y) / 6, 1.0)
    for k, w in enumerate(weights):
        for index in list(np.ndindex(w.shape))[:6]:
            up, down = [v.copy() for v in weights], [v.copy() for v in weights]
            up[k][index] += 1e-6
            down[k][index] -= 1e-6
            slope = (
                C.logistic_loss(C.forward(up, x)[0], y).mean()
                - C.logistic_loss(C.forward(down, x)[0], y).mean()
            ) / 2e-6
            assert grads[k][index] == pytest.approx(slope, abs=1e-5)


def training_rows(spark, n=1500):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        f = rng.uniform(-1, 1)
        rows.append((f"s{i}", rng.random(), f, f + 0.3 * rng.gauss(0, 1) > 0, ["A"], True, True))
    return spark.createDataFrame(
        rows,
        "spectrum_id string, confidence double, f double, correct boolean, prediction array<string>, "
        "valid_prediction boolean, valid_sequence boolean",
    )


def test_fit_depends_on_neither_partitions_nor_settings(spark):
    rows = training_rows(spark)
    weights = []
    for partitions in (2, 16):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        model = C.ProbabilityCalibrator(["f"], hidden_dims=(4,), batch_size=64, max_epochs=2, dropout=0.2)
        model.fit(rows.repartition(partitions))
        weights.append(np.concatenate([w.ravel() for w in model.weights]))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert np.allclose(weights[0], weights[1], atol=1e-9)


@pytest.mark.parametrize("shards", [1, 4])
def test_training_learns_and_stops(spark, shards):
    """One task, and several averaged tasks, reach a good fit."""
    rows = training_rows(spark)
    train, val = split.random_split(rows, "spectrum_id", 0.2)
    model = C.ProbabilityCalibrator(
        ["f"], hidden_dims=(8,), batch_size=64, learning_rate=0.02, max_epochs=12,
        n_iter_no_change=2, tol=0.001, dropout=0.0, val_early_stopping_max_psms=100, shards=shards,
    )
    seen = []
    history = model.fit(train, val, id_column="spectrum_id", epoch_callback=lambda e, v: seen.append(v))
    assert history.epochs_trained <= 12 and seen == history.val_losses
    assert history.best_epoch <= history.epochs_trained - 1
    assert min(history.val_losses) < 0.45 and history.final_val_accuracy > 0.8
    assert history.frame(spark).count() == history.epochs_trained
    with pytest.raises(ValueError, match="frozen"):
        model.fit(train)
    scored = model.predict(rows)
    means = scored.groupBy("correct").agg(F.avg("calibrated_confidence")).collect()
    means = {r[0]: r[1] for r in means}
    assert means[True] > means[False] + 0.3


def test_sigmoid_backend(spark, tmp_path):
    rows = training_rows(spark, 300)
    model = C.ProbabilityCalibrator(["f"], hidden_dims=(4,), max_epochs=20, backend="sigmoid")
    history = model.fit(rows, rows)
    assert history.train_losses[-1] < history.train_losses[0]
    model.save(spark, str(tmp_path / "m"))
    loaded = C.ProbabilityCalibrator.load(spark, str(tmp_path / "m"))
    a = model.predict(rows).agg(F.sum("calibrated_confidence")).first()[0]
    b = loaded.predict(rows).agg(F.sum("calibrated_confidence")).first()[0]
    assert a == pytest.approx(b)


def test_model_errors(spark):
    with pytest.raises(ValueError, match="always the first input"):
        C.ProbabilityCalibrator(["confidence"])
    with pytest.raises(ValueError, match="duplicate"):
        C.ProbabilityCalibrator(["a", "a"])
    with pytest.raises(ValueError, match="not fitted"):
        C.ProbabilityCalibrator(["f1"]).predict(golden_rows(spark))
    with pytest.raises(ValueError, match="missing feature"):
        fixed_model().predict(golden_rows(spark).drop("f2"))
    with pytest.raises(ValueError, match="empty"):
        fixed_model().predict(golden_rows(spark).limit(0))
    with pytest.raises(ValueError, match="labelled row"):
        C.ProbabilityCalibrator(["f"]).fit(training_rows(spark, 5).limit(0))


# --- split -------------------------------------------------------------------------


def test_random_split_is_exact_and_stable(spark, monkeypatch):
    monkeypatch.setattr(split, "_SMALL_CELL", 0)  # force the refinement levels
    df = spark.range(5000).selectExpr("cast(id AS string) AS i")
    train, val = split.random_split(df, "i", 0.1, seed=3)
    assert (train.count(), val.count()) == (4500, 500)
    again = split.random_split(df.repartition(13), "i", 0.1, seed=3)[1]
    assert val.exceptAll(again).count() == 0
    other = split.random_split(df, "i", 0.1, seed=4)[1]
    assert val.exceptAll(other).count() > 300
    assert split.random_split(df, "i", 0)[1] is None
    assert split.random_split(df.limit(3), "i", 0.1)[1].count() == 1
    assert split.sample_at_most(df, "i", 70).count() == 70
    assert split.sample_at_most(df, "i", None).count() == 5000


# --- joins ---------------------------------------------------------------------------


def test_salted_join_keeps_every_row(spark, tiny_limits):
    spectra = spark.range(20).selectExpr("cast(id AS string) AS spectrum_id", "id * 10 AS x")
    preds = spark.range(90).selectExpr(
        "cast(CASE WHEN id % 3 = 0 THEN 7 ELSE id % 20 END AS string) AS spectrum_id", "id AS p"
    )
    out = joins.join_spectra(preds, spectra)
    assert out.count() == 90 and out.select("p").distinct().count() == 90
    assert out.filter("cast(spectrum_id AS int) * 10 <> x").count() == 0
    with pytest.raises(ValueError, match="must be unique"):
        joins.join_spectra(preds, spectra.union(spectra))
    with pytest.raises(ValueError, match="no spectrum for"):
        joins.join_spectra(preds, spectra.filter("x > 50"))


# --- proteome ----------------------------------------------------------------------------


@pytest.mark.parametrize("scaled", [False, True])
def test_hits_equal_brute_force(spark, scaled, request, monkeypatch):
    if scaled:
        request.getfixturevalue("tiny_limits")
        monkeypatch.setattr(scale, "ROWS_PER_BUCKET", 250_000)
    monkeypatch.setattr(proteome, "PIECE_LENGTH", 16)
    monkeypatch.setattr(proteome, "CHUNK_LENGTH", 40)
    monkeypatch.setattr(proteome, "SPAN", 12)
    rng = random.Random(2)
    hay = ["".join(rng.choice("ALK") for _ in range(rng.randint(1, 90))) for _ in range(12)]
    hay += [hay[0]] * 6 + ["A" * 80]
    peps = {"A" * n for n in (1, 3, 7, 40, 81)}
    for _ in range(60):
        n = rng.choice([2, 5, 7, 8, 15, 30])
        text = rng.choice(hay)
        at = rng.randint(0, max(0, len(text) - 1))
        peps.add(text[at : at + n] if rng.random() < 0.6 else "".join(rng.choice("ALK") for _ in range(n)))
    peps.discard("")
    got = proteome.found_peptides(
        spark.createDataFrame([(p,) for p in sorted(peps)] * 2, "peptide string"),
        spark.createDataFrame([(h,) for h in hay], "sequence string"),
    )
    assert sorted(r[0] for r in got.collect()) == sorted(p for p in peps if any(p in h for h in hay))


@pytest.mark.parametrize("seeds", [500_000, 1])
def test_one_very_long_peptide_among_short_ones(spark, monkeypatch, seeds):
    monkeypatch.setattr(proteome, "MAX_SEED_ROWS", seeds)
    rng = random.Random(3)
    hay = "".join(rng.choice("ACDEFGHKLMNPQRSTVWY") for _ in range(30_000))
    peps = [hay[5_000:25_000], hay[29_990:], hay[100:109], hay[0:65], "WWWWWWWWW", hay[5_000:24_999] + "X"]
    got = proteome.found_peptides(
        spark.createDataFrame([(p,) for p in peps], "peptide string"),
        spark.createDataFrame([(hay,), (None,), ("",)], "sequence string"),
    )
    assert {r[0] for r in got.collect()} == {p for p in peps if p in hay}


def test_annotate_hits(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(">prot1\nXXXXXXMKLLPEPTLDEMKLLYYYY\n")
    psms = spark.createDataFrame(
        [("a", list("PEPTIDE"), None), ("b", list("AAAAAAA"), "PEP[UNIMOD:1]TIDE"),
         ("c", list("GGGGGGG"), " "), ("d", list("PEP"), None)],
        "id string, prediction array<string>, prediction_untokenised string",
    ).withColumn("valid_prediction", F.lit(True))
    out, counts = jobs.annotate_proteome(psms, saved.scan_fasta(spark, str(tmp_path / "p.fasta")))
    assert {r["id"]: r["proteome_hit"] for r in out.collect()} == {"a": True, "b": True, "c": False}
    assert tuple(counts.first()) == (4, 1, 3)


# --- diagnostics ---------------------------------------------------------------------------


def test_tail_diagnostic_invariants(spark):
    rng = random.Random(0)
    data = [(0.7 + 0.3 * i / 400, rng.random() < 0.8) for i in range(400)]
    df = spark.createDataFrame(data, "s double, y boolean")
    row = diagnostics.tail_diagnostic(df, "s", "y", 0.75, 0.05).first()
    assert row["tece"] >= abs(row["stece"]) - 1e-12
    assert row["stece"] == pytest.approx(row["stece_empirical"])
    falses = df.withColumn("y", F.lit(False))
    low = diagnostics.tail_diagnostic(falses, "s", "y", 0.7, 0.05).first()
    assert low["stece"] < 0 and "over-confident" in low["interpretation"]
    with pytest.raises(ValueError, match="has 1 rows, fewer"):
        diagnostics.tail_diagnostic(df, "s", "y", data[-1][0], 0.05)
    perfect = spark.createDataFrame([(1.0, True), (0.0, False)], "s double, y boolean")
    assert diagnostics.tail_error(perfect, "s", "y", 0.0).first()["stece_empirical"] == 0


def test_label_config(spark):
    with pytest.raises(ValueError, match="take no label_column"):
        diagnostics.check_label_config("sequence", "x")
    with pytest.raises(ValueError, match="need a label_column"):
        diagnostics.check_label_config("precomputed", None)
    with pytest.raises(ValueError, match="label_source"):
        diagnostics.check_label_config("other", None)
    with pytest.raises(ValueError, match="missing column"):
        diagnostics.resolve_labels(spark.range(1), "precomputed", "absent")


# --- plans -------------------------------------------------------------------------------------


def test_train_predict_diagnose(spark, tmp_path):
    rows = training_rows(spark, 900).withColumn("sequence", F.array(F.lit("A")))
    rows = rows.withColumn("precursor_charge", F.lit(2))
    extra = CustomFeature("square", ["g"], lambda d: d.withColumn("g", F.col("f") * F.col("f")))
    keep = CustomFeature("plain", ["f"], lambda d: d)
    features = FeatureSet(SequenceLength(), keep, extra)
    stored = jobs.compute_features(
        rows, features, metadata_path=str(tmp_path / "m.parquet"), matrix_path=str(tmp_path / "x")
    )
    assert stored.count() == 900
    trained = jobs.train(
        rows, features, hidden_dims=(8,), batch_size=64, learning_rate=0.02, max_epochs=8, dropout=0.0
    )
    out = jobs.predict(
        rows, trained.model, features, threshold=0.3, output_folder=str(tmp_path / "o")
    )
    kept = out.agg(F.min("calibrated_confidence"), F.max("psm_fdr"), F.count("*")).first()
    assert kept[2] > 100 and kept[1] <= 0.3 + 1e-9
    assert {"psm_pep", "psm_q_value"} <= set(out.columns)
    based = jobs.predict(rows, trained.model, features, threshold=0.3, method="label_based")
    assert "psm_pep" not in based.columns and based.count() > 100
    scored = trained.model.predict(features(rows))
    report = jobs.diagnose(scored, 0.3, report_path=str(tmp_path / "r")).first()
    assert report["n_tail"] >= 100 and report["label_source"] == "sequence"
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    two_phase = jobs.train(
        features_path=str(tmp_path / "x"), spark=spark, hidden_dims=(4,), batch_size=64, max_epochs=2
    )
    assert set(two_phase.model.feature_columns) == {"sequence_length", "precursor_charge", "f", "g"}
    with pytest.raises(ValueError, match="unknown training feature"):
        jobs.train(rows, features, training_feature_columns=["absent"])
    with pytest.raises(ValueError, match="unknown FDR method"):
        jobs.predict(rows, trained.model, features, method="other")


def test_stream_equals_batch(spark, tmp_path):
    rows = training_rows(spark, 200).drop("correct", "valid_sequence")
    rows.write.parquet(str(tmp_path / "in"))
    model = C.ProbabilityCalibrator(["f"], hidden_dims=(2,))
    model.mean, model.std = [0.5, 0.0], [0.3, 0.6]
    model.weights = C.init_weights([2, 2, 1], 1)
    keep = FeatureSet()
    scored = model.predict(rows)
    curve = fdr.fit_label_free(scored.filter("confidence > 0.5"), "calibrated_confidence")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = (
        scoring.score_stream(stream, model, keep, curve)
        .select("spectrum_id", "psm_fdr", "psm_pep")
        .writeStream.format("memory").queryName("scored_stream")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    got = {r[0]: (r[1], r[2]) for r in spark.table("scored_stream").collect()}
    batch = fdr.add_pep(
        fdr.annotate(scored, "calibrated_confidence", curve), "calibrated_confidence"
    )
    want = {r["spectrum_id"]: (r["psm_fdr"], r["psm_pep"]) for r in batch.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("broadcast, fan_out, bucket", [(1_000_000, 32, 2_000_000), (1, 3, 7), (2, 2, 50), (5, 4, 3)])
def test_static_curve_of_any_size_carries_little(spark, monkeypatch, broadcast, fan_out, bucket):
    rng = random.Random(8)
    points = sorted({round(rng.random(), 3) for _ in range(150)})
    fdrs = [rng.choice([0.5, 0.4, 0.3]) if i % 5 else 0.3 for i in range(len(points))]
    frame = spark.createDataFrame([(s, 1, f, f) for s, f in zip(points, fdrs)], "score double, n bigint, psm_fdr double, low_fdr double")
    curve = fdr.curve_from_points(frame, len(points))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(scale, "ROWS_PER_BUCKET", bucket)
    monkeypatch.setattr(scoring, "FAN_OUT", fan_out)
    kept = [r["score"] for r in scoring.steps(curve).orderBy("rank").collect()]
    assert kept == [s for i, s in enumerate(points) if i == 0 or fdrs[i] != fdrs[i - 1]]
    asked = [None, float("nan"), -1.0, 0.0, 1.0, 2.0, *points, *(round(rng.random(), 4) for _ in range(100))]
    rows = spark.createDataFrame([(x,) for x in asked], "s double").withColumn("_node", F.lit("x")).drop("_node")
    found = scoring.with_static_fdr(rows, "s", curve).collect()
    assert len(found) == len(asked)
    for r in found:
        below = [f for s, f in zip(points, fdrs) if r.s is not None and s <= r.s]
        missing = r.s is None or r.s != r.s
        assert r.psm_fdr == (None if missing else below[-1] if below else 1.0)
    # What a row carries is one node, whatever the size of the curve.
    sizes = scoring._children(scoring.steps(curve), 1).agg(F.max(F.size("_children"))).first()[0]
    assert sizes <= fan_out


@pytest.mark.parametrize("bucket", [2_000_000, 40, 7, 1])
def test_isotonic_fit_is_the_same_in_any_number_of_buckets(spark, monkeypatch, bucket):
    rng = random.Random(bucket)
    monkeypatch.setattr(scale, "ROWS_PER_BUCKET", bucket)
    for shape in ("rising", "falling", "mixed"):
        n = [rng.randint(1, 9) for _ in range(60)]
        at = {"rising": lambda i: i / 60, "falling": lambda i: 1 - i / 60, "mixed": lambda i: rng.random()}[shape]
        good = [sum(rng.random() < at(i) for _ in range(k)) for i, k in enumerate(n)]
        blocks = []
        for i, (k, g) in enumerate(zip(n, good)):
            blocks.append([k, g, [i]])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
        want = {i: g / k for k, g, members in blocks for i in members}
        counts = spark.createDataFrame([(float(i), k, g) for i, (k, g) in enumerate(zip(n, good))], "score double, n bigint, good bigint")
        found = {int(r.score): r.rate for r in diagnostics.isotonic_rates(counts).collect()}
        assert found == pytest.approx(want)
    empty = spark.createDataFrame([], "score double, n bigint, good bigint")
    assert diagnostics.isotonic_rates(empty).collect() == []
