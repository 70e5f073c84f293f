"""Registered queries: FDR, evaluation and diagnostics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spectrafdr.functions.scores import at_least
from spectrafdr.operators import diagnostics, evaluation, fdr, filters, scale, split
from spectrafdr.operators.calibrator import feature_matrix, standardisation
from spectrafdr.plans import jobs
from spectrafdr.sources import saved
from spectrafdr.streaming.scoring import with_static_fdr
from spectrafdr.workload import views as V
from spectrafdr.workload.registry import query, rnd

# Row-level FDR of the label-free rank; all rows of a tie take the first position.
LABEL_FREE = f"""WITH {V.PSM_SQL}, ranked AS (
  SELECT *, avg(1e0 - confidence) OVER (ORDER BY confidence DESC, event_id
                                        ROWS UNBOUNDED PRECEDING) AS run FROM psm),
curve AS (SELECT confidence AS score, count(*) AS n, min(run) AS fdr FROM ranked GROUP BY 1)"""

# Label-based rank: incorrect rows first within a score, 10 positions dropped.
LABEL_BASED = f"""WITH {V.PSM_SQL}, ranked AS (
  SELECT *, row_number() OVER w AS pos,
         1e0 - avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) OVER (
           ORDER BY confidence DESC, correct, event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM psm WINDOW w AS (ORDER BY confidence DESC, correct, event_id)),
kept AS (SELECT * FROM ranked WHERE pos > 10),
curve AS (SELECT confidence AS score, arg_min(run, pos) AS fdr, min(run) AS low FROM kept GROUP BY 1)"""

QVALUE = "min(fdr) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING)"
GRID = [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55]
GRID_SQL = ", ".join(f"({t!r}::double)" for t in GRID)


@query(
    "fdr_label_free",
    f"""{LABEL_FREE} SELECT spectrum_id, round(confidence, 6) AS confidence, round(fdr, 6) AS psm_fdr
        FROM psm JOIN curve ON confidence = score""",
)
def fdr_label_free(spark, d):
    rows = V.psm(spark, d).select("spectrum_id", "confidence")
    out = fdr.annotate(rows, "confidence", fdr.fit_label_free(rows, "confidence"), same_scores=True)
    return out.select("spectrum_id", rnd("confidence"), rnd("psm_fdr"))


@query(
    "q_values",
    f"""{LABEL_FREE}, q AS (SELECT score, {QVALUE} AS q FROM curve)
        SELECT spectrum_id, round(q, 6) AS psm_q_value FROM psm JOIN q ON confidence = score""",
)
def q_values(spark, d):
    rows = V.psm(spark, d).select("spectrum_id", "confidence")
    out = fdr.annotate(rows, "confidence", fdr.fit_label_free(rows, "confidence"), same_scores=True)
    return out.select("spectrum_id", rnd("psm_q_value"))


@query("pep", f"WITH {V.PSM_SQL} SELECT spectrum_id, round(1e0 - confidence, 6) AS psm_pep FROM psm")
def pep(spark, d):
    return fdr.add_pep(V.psm(spark, d), "confidence").select("spectrum_id", rnd("psm_pep"))


@query(
    "fdr_cutoffs",
    f"""{LABEL_FREE}, grid(threshold) AS (VALUES {GRID_SQL})
        SELECT threshold, round(min(score), 6) AS cutoff
        FROM grid LEFT JOIN curve ON fdr <= threshold GROUP BY 1""",
)
def fdr_cutoffs(spark, d):
    curve = fdr.fit_label_free(V.psm(spark, d), "confidence")
    return fdr.cutoffs_at(curve, GRID).select("threshold", rnd("cutoff"))


@query(
    "confidence_curve",
    f"""{LABEL_FREE}, grid AS (SELECT range AS k, 5e-2 + range * 5e-3 AS threshold FROM range(0, 100))
        SELECT cast(k AS integer) AS k, round(min(score), 6) AS cutoff
        FROM grid LEFT JOIN curve ON fdr <= threshold GROUP BY 1""",
)
def confidence_curve(spark, d):
    curve = fdr.fit_label_free(V.psm(spark, d), "confidence")
    out = fdr.confidence_curve(curve, 0.005, 0.05, 0.5475)
    return out.select(
        F.round((F.col("threshold") - 0.05) / 0.005).cast("int").alias("k"), rnd("cutoff")
    )


FILTERED = f"""{LABEL_FREE}, cut AS (SELECT min(score) AS c FROM curve WHERE fdr <= 0.25::double)
  SELECT spectrum_id, round(confidence, 6) AS confidence, round(fdr, 6) AS psm_fdr,
         round(q, 6) AS psm_q_value, round(1e0 - confidence, 6) AS psm_pep
  FROM psm JOIN (SELECT score, fdr, {QVALUE} AS q FROM curve) c ON confidence = score, cut
  WHERE confidence >= cut.c"""


@query("fdr_filter", FILTERED)
def fdr_filter(spark, d):
    """Flagship: annotate FDR, q-value and PEP, keep the rows within a 25 % FDR."""
    rows = V.psm(spark, d).select("spectrum_id", "confidence")
    curve = fdr.fit_label_free(rows, "confidence")
    out = fdr.control_fdr(rows, "confidence", 0.25, curve, same_scores=True)
    return out.select(
        "spectrum_id", rnd("confidence"), rnd("psm_fdr"), rnd("psm_q_value"), rnd("psm_pep")
    )


@query(
    "fdr_filter_strict",
    f"""{LABEL_FREE}, cut AS (SELECT min(score) AS c FROM curve WHERE fdr <= 0.3::double)
        SELECT spectrum_id FROM psm, cut WHERE confidence > cut.c""",
)
def fdr_filter_strict(spark, d):
    rows = V.psm(spark, d).select("spectrum_id", "confidence")
    curve = fdr.fit_label_free(rows, "confidence")
    cutoff = fdr.confidence_cutoff(curve, 0.3)
    return fdr.filter_above(rows, "confidence", cutoff).select("spectrum_id")


LABEL_BASED_ROWS = f"""{LABEL_BASED}, top AS (SELECT arg_min(run, pos) AS f FROM kept),
  looked AS (SELECT p.confidence AS score, any_value(coalesce(c.fdr, top.f)) AS fdr
             FROM psm p LEFT JOIN curve c ON p.confidence = c.score, top GROUP BY 1)
  SELECT spectrum_id, round(fdr, 6) AS psm_fdr, round(q, 6) AS psm_q_value
  FROM psm JOIN (SELECT score, fdr, {QVALUE} AS q FROM looked) l ON confidence = l.score"""


@query("fdr_label_based", LABEL_BASED_ROWS)
def fdr_label_based(spark, d):
    rows = V.psm(spark, d).select(
        "spectrum_id", "confidence", "correct", F.lit(True).alias("valid_sequence")
    )
    curve = fdr.fit_label_based(rows, "confidence", drop=10)
    out = fdr.annotate(rows, "confidence", curve)
    return out.select("spectrum_id", rnd("psm_fdr"), rnd("psm_q_value"))


@query(
    "fdr_label_based_cutoffs",
    f"""{LABEL_BASED}, grid(threshold) AS (VALUES {GRID_SQL})
        SELECT threshold, round(min(score), 6) AS cutoff
        FROM grid LEFT JOIN curve ON low <= threshold GROUP BY 1""",
)
def fdr_label_based_cutoffs(spark, d):
    rows = V.psm(spark, d).withColumn("valid_sequence", F.lit(True))
    curve = fdr.fit_label_based(rows, "confidence", drop=10)
    return fdr.cutoffs_at(curve, GRID).select("threshold", rnd("cutoff"))


@query(
    "fdr_eligible_labels",
    f"""WITH {V.DOC_SQL}, ranked AS (
        SELECT *, row_number() OVER (ORDER BY confidence DESC, correct, doc_id) AS pos,
          1e0 - avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) OVER (
            ORDER BY confidence DESC, correct, doc_id ROWS UNBOUNDED PRECEDING) AS run
        FROM doc WHERE valid_sequence)
        SELECT round(confidence, 6) AS score, round(arg_min(run, pos), 6) AS fdr
        FROM ranked WHERE pos > 10 GROUP BY confidence""",
)
def fdr_eligible_labels(spark, d):
    """Only documents that carry a label enter the label-based curve."""
    curve = fdr.fit_label_based(V.documents_scored(spark, d), "confidence", drop=10)
    return curve.points.select(rnd("score"), rnd("psm_fdr", "fdr"))


@query(
    "asof_transfer",
    f"""WITH {V.PSM_SQL}, ranked AS (
        SELECT *, avg(1e0 - confidence) OVER (ORDER BY confidence DESC, event_id
                                              ROWS UNBOUNDED PRECEDING) AS run
        FROM psm WHERE experiment_name = 'click'),
        curve AS (SELECT confidence AS score, min(run) AS fdr FROM ranked GROUP BY 1),
        probe AS (SELECT DISTINCT confidence AS score FROM psm WHERE experiment_name <> 'click'),
        looked AS (SELECT p.score, coalesce(c.fdr, 1e0) AS fdr
                   FROM probe p ASOF LEFT JOIN curve c ON p.score >= c.score)
        SELECT spectrum_id, round(fdr, 6) AS psm_fdr, round(q, 6) AS psm_q_value
        FROM psm JOIN (SELECT score, fdr, {QVALUE} AS q FROM looked) l ON confidence = l.score
        WHERE experiment_name <> 'click'""",
)
def asof_transfer(spark, d):
    rows = V.psm(spark, d).select("spectrum_id", "experiment_name", "confidence")
    curve = fdr.fit_label_free(rows.filter("experiment_name = 'click'"), "confidence")
    out = fdr.annotate(rows.filter("experiment_name <> 'click'"), "confidence", curve)
    return out.select("spectrum_id", rnd("psm_fdr"), rnd("psm_q_value"))


@query(
    "static_curve_lookup",
    f"""WITH {V.PSM_SQL}, ranked AS (
        SELECT *, avg(1e0 - confidence) OVER (ORDER BY confidence DESC, event_id
                                              ROWS UNBOUNDED PRECEDING) AS run
        FROM psm WHERE experiment_name = 'click'),
        curve AS (SELECT confidence AS score, min(run) AS fdr FROM ranked GROUP BY 1)
        SELECT p.spectrum_id, round(coalesce(c.fdr, 1e0), 6) AS psm_fdr
        FROM psm p ASOF LEFT JOIN curve c ON p.confidence >= c.score""",
)
def static_curve_lookup(spark, d):
    """The stateless look-up of the streaming path."""
    rows = V.psm(spark, d).select("spectrum_id", "experiment_name", "confidence")
    curve = fdr.fit_label_free(rows.filter("experiment_name = 'click'"), "confidence")
    return with_static_fdr(rows, "confidence", curve).select(
        "spectrum_id", rnd("psm_fdr")
    )


@query(
    "stream_scoring",
    f"""WITH {V.PSM_SQL}, ranked AS (
        SELECT *, avg(1e0 - confidence) OVER (ORDER BY confidence DESC, event_id
                                              ROWS UNBOUNDED PRECEDING) AS run
        FROM psm WHERE experiment_name <> 'click'),
        curve AS (SELECT confidence AS score, min(run) AS fdr FROM ranked GROUP BY 1)
        SELECT p.spectrum_id, round(coalesce(c.fdr, 1e0), 6) AS psm_fdr,
          round(1e0 - p.confidence, 6) AS psm_pep
        FROM psm p ASOF LEFT JOIN curve c ON p.confidence >= c.score
        WHERE p.confidence >= 0.25::double""",
)
def stream_scoring(spark, d):
    """Events as a stream, scored by a curve fitted on stored ones, appended to a table."""
    fitted = V.psm(spark, d).filter("experiment_name <> 'click'")
    curve = fdr.fit_label_free(fitted, "confidence")
    stream = V.psm_of(V.stream(spark, d, "events"))
    kept = stream.filter(at_least(F.col("confidence"), 0.25))
    scored = fdr.add_pep(with_static_fdr(kept, "confidence", curve), "confidence")
    folder = f"{scale.shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = scored.select("spectrum_id", rnd("psm_fdr"), rnd("psm_pep"))
    run = (
        out.writeStream.format("parquet").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


@query(
    "yield_at_fdr",
    f"""{LABEL_FREE}, grid(threshold) AS (VALUES {GRID_SQL}),
        cut AS (SELECT threshold, min(score) AS c FROM grid LEFT JOIN curve ON fdr <= threshold GROUP BY 1)
        SELECT threshold, (SELECT count(*) FROM psm WHERE confidence >= cut.c) AS n_psms FROM cut""",
)
def yield_at_fdr(spark, d):
    rows = V.psm(spark, d)
    curve = fdr.fit_label_free(rows, "confidence")
    return fdr.yield_at(rows, "confidence", fdr.cutoffs_at(curve, GRID)).select(
        "threshold", "n_psms"
    )


# --- evaluation ---------------------------------------------------------------


@query(
    "precision_recall",
    f"""WITH {V.PSM_SQL}, r AS (
        SELECT event_id, row_number() OVER w AS rank,
          sum(CASE WHEN correct THEN 1 ELSE 0 END) OVER w AS hits, count(*) OVER () AS n
        FROM psm WINDOW w AS (ORDER BY confidence DESC, event_id ROWS UNBOUNDED PRECEDING))
        SELECT event_id, rank, round(hits / rank, 6) AS precision, round(hits / n, 6) AS recall,
               round(1e0 - hits / rank, 6) AS fdr FROM r""",
)
def precision_recall(spark, d):
    out = evaluation.precision_recall(V.psm(spark, d), "confidence", "correct", "event_id")
    return out.select("event_id", "rank", rnd("precision"), rnd("recall"), rnd("fdr"))


@query(
    "calibration_curve_width",
    f"""WITH {V.PSM_SQL}
        SELECT cast(greatest(1, ceil(confidence * 20)) AS integer) AS bin,
          round(avg(confidence), 6) AS mean_score,
          round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END), 6) AS empirical_rate, count(*) AS n,
          round((cast(greatest(1, ceil(confidence * 20)) AS integer) - 5e-1) / 2e1, 6) AS centre
        FROM psm GROUP BY 1, 5""",
)
def calibration_curve_width(spark, d):
    out = evaluation.calibration_curve_width(V.psm(spark, d), "confidence", "correct", 20)
    return out.select("bin", rnd("mean_score"), rnd("empirical_rate"), "n", rnd("centre"))


@query(
    "calibration_curve_freq",
    f"""WITH {V.PSM_SQL}, r AS (
        SELECT *, row_number() OVER (ORDER BY confidence, correct, event_id) AS p1, count(*) OVER () AS n
        FROM psm)
        SELECT cast((p1 * 40 + n - 1) // n - 1 AS integer) AS bin, round(avg(confidence), 6) AS mean_score,
          round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END), 6) AS empirical_rate, count(*) AS weight
        FROM r GROUP BY 1""",
)
def calibration_curve_freq(spark, d):
    out = evaluation.calibration_curve_frequency(V.psm(spark, d), "confidence", "correct", 40)
    return out.select("bin", rnd("mean_score"), rnd("empirical_rate"), "weight")


@query(
    "score_histogram",
    f"""WITH {V.PSM_SQL} SELECT cast(least(floor(confidence * 100), 99) AS integer) AS bin, correct,
        count(*) AS n FROM psm GROUP BY 1, 2""",
)
def score_histogram(spark, d):
    return evaluation.score_histogram(V.psm(spark, d), "confidence", "correct", 100)


@query(
    "loss_accuracy",
    f"""WITH {V.PSM_SQL}, z AS (SELECT (confidence - 5e-1) * 4e0 AS z,
        CASE WHEN correct THEN 1e0 ELSE 0e0 END AS y FROM psm)
        SELECT round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0e0) - y * z), 6) AS loss,
          round(avg(CASE WHEN (z > 0) = (y = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM z""",
)
def loss_accuracy(spark, d):
    rows = V.psm(spark, d).select(F.expr("(confidence - 5e-1) * 4e0").alias("z"), "correct")
    return evaluation.classification_metrics(rows, "z", "correct").select(
        rnd("loss"), rnd("accuracy")
    )


# --- diagnostics ----------------------------------------------------------------


@query(
    "tail_error",
    f"""WITH {V.PSM_SQL} SELECT count(*) AS n_tail,
        round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) - avg(confidence), 6) AS stece_empirical
        FROM psm WHERE confidence >= 0.7::double""",
)
def tail_error(spark, d):
    return diagnostics.tail_error(V.psm(spark, d), "confidence", "correct", 0.7).select(
        "n_tail", rnd("stece_empirical")
    )


LINE_SCORES = """line AS (
  SELECT l_quantity / 5e1 AS score,
    CASE WHEN ((l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 50) / 5e1 < l_quantity / 5e1
         THEN 1e0 ELSE 0e0 END AS y FROM lineitem),
point AS (SELECT score, count(*) AS n, sum(y) AS good, row_number() OVER (ORDER BY score) AS i
  FROM line WHERE score >= 0.3::double GROUP BY score),
block AS (SELECT a.i AS lo, b.i AS hi, sum(c.good) / sum(c.n) AS mean
  FROM point a JOIN point b ON a.i <= b.i JOIN point c ON c.i BETWEEN a.i AND b.i GROUP BY 1, 2),
lower AS (SELECT p.i, b.lo, min(b.mean) AS m
  FROM point p JOIN block b ON b.lo <= p.i AND b.hi >= p.i GROUP BY 1, 2),
iso AS (SELECT i, max(m) AS rate FROM lower GROUP BY 1)"""


def line_scores(spark, d):
    return V.table(spark, d, "lineitem").select(
        F.expr("l_quantity / 5e1").alias("score"),
        F.expr(
            "((l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 50) / 5e1 < l_quantity / 5e1"
        ).alias("hit"),
    )


@query(
    "isotonic_fit",
    f"""WITH {LINE_SCORES} SELECT round(score, 6) AS score, n, round(rate, 6) AS rate
        FROM point JOIN iso USING (i)""",
)
def isotonic_fit(spark, d):
    counts = diagnostics.tail_counts(line_scores(spark, d), "score", "hit", 0.3)
    return diagnostics.isotonic_rates(counts).select(rnd("score"), "n", rnd("rate"))


@query(
    "tail_isotonic",
    f"""WITH {LINE_SCORES} SELECT 0.3::double AS conf_cutoff, cast(sum(n) AS bigint) AS n_tail,
        round(sum(n * (rate - score)) / sum(n), 6) AS stece,
        round(sum(n * abs(rate - score)) / sum(n), 6) AS tece,
        round((sum(good) - sum(n * score)) / sum(n), 6) AS stece_empirical,
        abs(sum(n * (rate - score)) / sum(n)) <= 0.005::double AS within_tolerance
        FROM point JOIN iso USING (i)""",
)
def tail_isotonic(spark, d):
    out = diagnostics.tail_diagnostic(line_scores(spark, d), "score", "hit", 0.3, 0.05)
    return out.select(
        "conf_cutoff", "n_tail", rnd("stece"), rnd("tece"), rnd("stece_empirical"),
        "within_tolerance",
    )


@query(
    "diagnose_tail",
    f"""WITH {V.DOC_SQL}, ranked AS (
        SELECT *, avg(1e0 - confidence) OVER (ORDER BY confidence DESC, doc_id
                                              ROWS UNBOUNDED PRECEDING) AS run
        FROM doc WHERE valid_sequence),
        curve AS (SELECT confidence AS score, min(run) AS fdr FROM ranked GROUP BY 1),
        cut AS (SELECT min(score) AS c FROM curve WHERE fdr <= 0.4::double)
        SELECT round(any_value(c), 6) AS conf_cutoff, count(*) AS n_tail,
          round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) - avg(confidence), 6) AS stece
        FROM doc, cut WHERE valid_sequence AND confidence >= c""",
)
def diagnose_tail(spark, d):
    """Label-free cut-off of the labelled rows, then the tail record.

    On the fitted rows the isotonic signed error equals the empirical one.
    """
    rows = V.documents_scored(spark, d).withColumn("sequence", F.array(F.lit("A")))
    out = jobs.diagnose(rows, 0.4, "confidence", min_tail_psms=10)
    return out.select(rnd("conf_cutoff"), "n_tail", rnd("stece"))


# --- label rules, splits, matrices ------------------------------------------------


@query(
    "label_eligibility",
    f"""WITH {V.DOC_SQL} SELECT source, count(*) AS n, sum(CASE WHEN correct THEN 1 ELSE 0 END)::bigint
        AS n_correct FROM doc WHERE valid_sequence GROUP BY 1""",
)
def label_eligibility(spark, d):
    rows = V.documents_scored(spark, d).withColumn("sequence", F.array(F.lit("A")))
    return filters.labelled(rows).groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("n_correct")
    )


@query(
    "drop_where",
    f"""WITH {V.PSM_SQL} SELECT spectrum_id FROM psm
        WHERE NOT (confidence < 0.2::double OR length(peptide) > 7)""",
)
def drop_where(spark, d):
    rows = V.psm(spark, d)
    return filters.drop_where(
        rows, F.col("confidence") < 0.2, F.length("peptide") > 7
    ).select("spectrum_id")


@query(
    "random_split",
    """SELECT part, n FROM (
         SELECT 'validation' AS part, greatest(1, cast(floor(count(*) * 1e-1) AS bigint)) AS n FROM events
         UNION ALL
         SELECT 'train', count(*) - greatest(1, cast(floor(count(*) * 1e-1) AS bigint)) FROM events)""",
)
def random_split(spark, d):
    train, val = split.random_split(V.psm(spark, d).select("spectrum_id"), "spectrum_id", 0.1, 42)
    return (
        train.withColumn("part", F.lit("train"))
        .unionByName(val.withColumn("part", F.lit("validation")))
        .groupBy("part")
        .agg(F.count("*").alias("n"))
    )


@query(
    "validation_sample",
    "SELECT least(500, count(*)) AS n, least(500, count(*)) AS n_ids FROM events",
)
def validation_sample(spark, d):
    rows = split.sample_at_most(V.psm(spark, d).select("spectrum_id"), "spectrum_id", 500, 7)
    return rows.agg(
        F.count("*").alias("n"), F.countDistinct("spectrum_id").alias("n_ids")
    )


@query(
    "standardise",
    """SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM (
        SELECT 'confidence' AS feature, avg(c) AS mean, stddev_samp(c) AS std
          FROM (SELECT value / (value + 5e1) AS c FROM events)
        UNION ALL SELECT 'user_id', avg(user_id), stddev_samp(user_id) FROM events)""",
)
def standardise(spark, d):
    return standardisation(V.psm(spark, d), ["confidence", "user_id"]).select(
        "feature", rnd("mean"), rnd("std")
    )


@query(
    "feature_matrix",
    f"""WITH {V.PSM_SQL} SELECT round(confidence, 6) AS confidence, cast(user_id AS double) AS user_id,
        round(retention_time, 3) AS retention_time, CASE WHEN correct THEN 1e0 ELSE 0e0 END AS correct
        FROM psm""",
)
def feature_matrix_query(spark, d):
    out = feature_matrix(V.psm(spark, d), ["user_id", "retention_time"])
    return out.select(rnd("confidence"), "user_id", rnd("retention_time", digits=3), "correct")


EXPORT = f"""{LABEL_FREE} SELECT spectrum_id, peptide AS prediction, round(confidence, 6) AS confidence,
  round(fdr, 6) AS psm_fdr, round(fdr, 6) AS psm_q_value FROM psm JOIN curve ON confidence = score"""


@query("export_split", EXPORT)
def export_split(spark, d):
    """The prediction / FDR half of an export, peptides as joined strings."""
    rows = V.psm(spark, d).select(
        "spectrum_id", "experiment_name", "confidence",
        F.split("peptide", "").alias("prediction"), "retention_time",
    )
    curve = fdr.fit_label_free(rows, "confidence")
    out = saved.export_metadata(fdr.annotate(rows, "confidence", curve, same_scores=True))
    _, predictions = saved.split_outputs(out, "confidence")
    return predictions.select(
        "spectrum_id", "prediction", rnd("confidence"), rnd("psm_fdr"), rnd("psm_q_value")
    )


@query(
    "union_experiments",
    """SELECT event_type AS experiment_name, count(*) AS n,
         count(CASE WHEN event_type = 'click' THEN user_id END) AS n_user,
         count(CASE WHEN event_type <> 'click' THEN value END) AS n_value FROM events GROUP BY 1""",
)
def union_experiments(spark, d):
    events = V.table(spark, d, "events").withColumnRenamed("event_type", "experiment_name")
    clicks = events.filter("experiment_name = 'click'").select("experiment_name", "user_id")
    others = events.filter("experiment_name <> 'click'").select("experiment_name", "value")
    return jobs.union_experiments([clicks, others]).groupBy("experiment_name").agg(
        F.count("*").alias("n"), F.count("user_id").alias("n_user"), F.count("value").alias("n_value")
    )
