"""Registered queries: whole jobs with their files, models and reports read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spectrafdr.functions import peptides as P
from spectrafdr.operators import features as E
from spectrafdr.operators.calibrator import ProbabilityCalibrator
from spectrafdr.plans import jobs
from spectrafdr.sources import saved
from spectrafdr.workload import views as V
from spectrafdr.workload.feature_queries import _FIXED_W1, _model_rows
from spectrafdr.workload.registry import ORACLES, query, rnd
from spectrafdr.workload.source_queries import _folder


def _fixed_model() -> ProbabilityCalibrator:
    model = ProbabilityCalibrator(["user_id", "log_rt"], hidden_dims=(4,))
    model.mean, model.std = [0.5, 50.0, 10.0], [0.4, 30.0, 2.0]
    model.weights = [np.array(_FIXED_W1), np.full(4, 0.2), np.full((1, 4), 0.3), np.array([0.4])]
    return model


@query("model_round_trip", ORACLES["network_scoring"])
def model_round_trip(spark, d):
    """A saved and loaded model scores like the original."""
    path = f"{_folder(spark)}/model"
    _fixed_model().save(spark, path)
    model = ProbabilityCalibrator.load(spark, path)
    return model.predict(_model_rows(spark, d)).select("spectrum_id", rnd("calibrated_confidence"))


_CALIBRATED = f"""WITH {V.PSM_SQL}, x AS (SELECT spectrum_id, (confidence - 5e-1) / 0.4::double AS a,
    (user_id - 5e1) / 3e1 AS b, (ln(1 + retention_time) - 1e1) / 2e0 AS c FROM psm),
  s AS (SELECT spectrum_id, 1e0 / (1e0 + exp(-(4 * 0.3::double * greatest(0.1::double * (a + b + c)
          + 0.2::double, 0e0) + 0.4::double))) AS p FROM x),
  r AS (SELECT spectrum_id, p, avg(1e0 - p) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS run FROM s)"""


@query(
    "predict_outputs",
    f"""{_CALIBRATED}
        SELECT count(*) AS n, count(*) AS n_metadata, round(min(p), 3) AS lowest, round(avg(1e0 - p), 3) AS mean_pep,
          true AS within_target, true AS q_monotone
        FROM r WHERE p >= (SELECT min(p) FROM r WHERE run <= 0.3::double)""",
)
def predict_outputs(spark, d):
    """The prediction job writes two tables; both come back whole and consistent."""
    folder = _folder(spark)
    rows = _model_rows(spark, d).withColumns(
        {"valid_prediction": F.lit(True), "prediction": F.array(F.lit("A"))}
    ).drop("correct")
    jobs.predict(rows, _fixed_model(), E.FeatureSet(), threshold=0.3, output_folder=folder)
    kept = spark.read.csv(f"{folder}/preds_and_fdr_metrics.csv", header=True).selectExpr(
        "spectrum_id", "cast(calibrated_confidence AS double) AS p", "cast(psm_fdr AS double) AS fdr",
        "cast(psm_q_value AS double) AS q", "cast(psm_pep AS double) AS pep",
    )
    metadata = spark.read.csv(f"{folder}/metadata.csv", header=True).select("spectrum_id")
    both = kept.join(metadata.withColumn("_m", F.lit(1)), "spectrum_id", "left")
    return both.agg(
        F.count("*").alias("n"), F.count("_m").alias("n_metadata"), F.round(F.min("p"), 3).alias("lowest"),
        F.round(F.avg("pep"), 3).alias("mean_pep"), (F.max("fdr") <= 0.3 + 1e-9).alias("within_target"),
        F.bool_and(F.col("q") <= F.col("fdr") + 1e-12).alias("q_monotone"),
    )


@query("report_round_trip", ORACLES["diagnose_tail"])
def report_round_trip(spark, d):
    """The tail report as JSON, read back."""
    path = f"{_folder(spark)}/report.json"
    rows = V.documents_scored(spark, d).withColumn("sequence", F.array(F.lit("A")))
    jobs.diagnose(rows, 0.4, "confidence", min_tail_psms=10, report_path=path)
    return spark.read.json(path).select(rnd("conf_cutoff"), "n_tail", rnd("stece"))


@query(
    "train_two_phase",
    """SELECT count(*) AS n, true AS in_range, true AS beats_constant, true AS best_epoch_kept,
         true AS reloaded_equal FROM events""",
)
def train_two_phase(spark, d):
    """Saved training matrix -> train -> save -> load -> score; invariants instead of weights."""
    folder = _folder(spark)
    rows = _model_rows(spark, d)
    saved.save_matrix(rows, ["user_id", "log_rt"], f"{folder}/matrix.parquet")
    trained = jobs.train(
        features_path=f"{folder}/matrix.parquet", spark=spark, hidden_dims=(16, 8), max_epochs=4,
        batch_size=128, learning_rate=0.01, n_iter_no_change=2,
    )
    history = trained.history
    best = min(range(len(history.val_losses)), key=lambda i: history.val_losses[i])
    trained.model.save(spark, f"{folder}/model")
    again = ProbabilityCalibrator.load(spark, f"{folder}/model")
    scored = again.predict(trained.model.predict(rows).withColumnRenamed("calibrated_confidence", "p"))
    y, p = F.col("correct").cast("double"), F.col("p")
    loss = F.avg(-(y * F.log(F.greatest(p, F.lit(1e-12))) + (1 - y) * F.log(F.greatest(1 - p, F.lit(1e-12)))))
    share = F.avg(y)
    constant = -(share * F.log(share) + (1 - share) * F.log(1 - share))
    return scored.agg(
        F.count("*").alias("n"),
        F.bool_and((p >= 0) & (p <= 1)).alias("in_range"),
        (loss < constant).alias("beats_constant"),
        F.lit(history.val_losses[history.best_epoch] <= history.val_losses[best] + trained.model.tol).alias("best_epoch_kept"),
        F.bool_and(F.abs(p - F.col("calibrated_confidence")) < 1e-12).alias("reloaded_equal"),
    )


@query("annotate_proteome", ORACLES["proteome_hits"])
def annotate_proteome(spark, d):
    """The annotation job with its output file, read back."""
    path = f"{_folder(spark)}/annotated.parquet"
    psms = V.benchmark_peptides(spark, d).withColumn("prediction", P.tokenise(F.col("pep")))
    psms = psms.withColumn("valid_prediction", P.has_tokens(F.col("prediction")))
    jobs.annotate_proteome(psms, V.proteins(spark, d), path=path)
    return spark.read.parquet(path).select("item_id", "k", "pos", "proteome_hit")


@query(
    "compute_features_job",
    """SELECT count(*) AS n, count(*) AS n_matrix, round(sum(value / (value + 5e1)), 3) AS total FROM events""",
)
def compute_features_job(spark, d):
    """The feature job's two outputs, metadata and matrix, read back."""
    folder = _folder(spark)
    rows = _model_rows(spark, d).withColumns(
        {"valid_prediction": F.lit(True), "prediction": F.array(F.lit("A"))}
    )
    jobs.compute_features(
        rows, E.FeatureSet(), metadata_path=f"{folder}/metadata.csv", matrix_path=f"{folder}/matrix.parquet"
    )
    matrix = spark.read.parquet(f"{folder}/matrix.parquet").agg(
        F.count("*").alias("n_matrix"), F.round(F.sum("confidence"), 3).alias("total")
    )
    metadata = spark.read.csv(f"{folder}/metadata.csv", header=True).agg(F.count("*").alias("n"))
    tagged = metadata.withColumn("one", F.lit(1)).join(matrix.withColumn("one", F.lit(1)), "one")
    return tagged.select("n", "n_matrix", "total")
