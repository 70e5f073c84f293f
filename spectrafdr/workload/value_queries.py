"""Registered queries: jobs with real features, training, splits, band joins, custom parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spectrafdr.functions import peptides as P
from spectrafdr.functions import spectra as N
from spectrafdr.operators import calibrator as C
from spectrafdr.operators import features as E
from spectrafdr.operators import fdr, filters, joins, scale, split
from spectrafdr.plans import jobs
from spectrafdr.sources import loaders, saved
from spectrafdr.sources.predictions import finalise
from spectrafdr.workload import views as V
from spectrafdr.workload.feature_queries import _BUNDLE, _BUNDLE_COLUMNS, _THEORY, _fragment_output, _fragment_rows
from spectrafdr.workload.registry import query, rnd
from spectrafdr.workload.source_queries import _folder

# --- PSMs with beams, token scores, missing scores and empty predictions ---------------------

# One row per order: its lines as candidates, best first. Every eleventh score is missing,
# every seventh NaN, every thirteenth prediction empty; those rows are not usable. A small part
# of the key keeps scores apart, so that no tie depends on rounding.
ORDER_SQL = f"""{V.CANDIDATE_SQL}, own AS (
  SELECT l_orderkey, list(prob ORDER BY prob DESC, seq, l_linenumber, l_tax DESC, l_quantity) AS p,
    list(seq ORDER BY prob DESC, seq, l_linenumber, l_tax DESC, l_quantity) AS s,
    list([1e0 - l_tax, l_quantity / 51e0] ORDER BY prob DESC, seq, l_linenumber, l_tax DESC, l_quantity) AS t
  FROM cand WHERE prob > 0 GROUP BY l_orderkey),
psm AS (
  SELECT l_orderkey, p, s, t[1] AS tp, s[1] AS seq, 300e0 + l_orderkey % 500 AS precursor_mz,
    cast(1 + l_orderkey % 4 AS integer) AS precursor_charge,
    0.05::double + 0.9::double * ((l_orderkey * 7919) % 1000) / 1e3 + l_orderkey * 1.0000007e-9 AS confidence,
    (l_orderkey * 31) % 100 < 60 AS correct
  FROM own WHERE l_orderkey % 11 <> 0 AND l_orderkey % 7 <> 0 AND l_orderkey % 13 <> 0),
th AS (SELECT *, {_THEORY} AS theory FROM psm),
er AS (SELECT l_orderkey, arg_min((theory - (precursor_mz - i * 1.00335::double / precursor_charge)) * precursor_charge,
         abs((theory - (precursor_mz - i * 1.00335::double / precursor_charge)) / precursor_mz) * 1e6 + i * 1e-12) AS da
       FROM th, range(0, 2) r(i) GROUP BY 1),
feat AS (
  SELECT psm.*, da AS mass_error_da, p[1] - coalesce(p[2], 0e0) AS margin,
    p[1] - list_median(CASE WHEN len(p) >= 2 THEN p[2:] ELSE [0e0] END) AS median_margin,
    CASE WHEN len(p) < 2 THEN 1e0 ELSE levenshtein(replace(s[1], 'L', 'I'), replace(s[2], 'L', 'I'))
      / greatest(length(s[1]), length(s[2])) END AS edit_distance,
    least(tp[1], tp[2]) AS min_token_probability, abs(tp[1] - tp[2]) / 2 AS std_token_probability,
    len(p) / precursor_charge AS beams_per_charge, len(p) * 1e0 AS n_beams
  FROM psm JOIN er USING (l_orderkey))"""


def order_psms(spark: SparkSession, folder: str) -> DataFrame:
    entry = F.struct(
        (-F.col("prob")).alias("k"), "seq", "l_linenumber", F.log("prob").alias("log_prob"),
        F.array(F.log(F.expr("1e0 - l_tax")), F.log(F.expr("l_quantity / 51e0"))).alias("logs"),
    )
    own = V.candidates(spark, folder).filter("prob > 0").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(entry)).alias("e")
    )
    key = F.col("l_orderkey")
    score = (
        F.when(key % 11 == 0, F.lit(None).cast("double"))
        .when(key % 7 == 0, F.lit(float("nan")))
        .otherwise(F.expr("0.05D + 0.9D * ((l_orderkey * 7919) % 1000) / 1e3 + l_orderkey * 1.0000007e-9"))
    )
    rows = own.select(
        "l_orderkey",
        key.cast("string").alias("spectrum_id"),
        F.when(key % 13 == 0, F.lit("")).otherwise(F.col("e")[0]["seq"]).alias("prediction"),
        F.expr("300e0 + l_orderkey % 500").alias("precursor_mz"),
        F.expr("cast(1 + l_orderkey % 4 AS int)").alias("precursor_charge"),
        score.alias("confidence"),
        ((key * 31) % 100 < 60).alias("correct"),
        F.transform(
            "e",
            lambda x: F.struct(
                P.tokenise(x["seq"]).alias("sequence"), x["log_prob"].alias("log_prob"), x["logs"].alias("token_log_probs")
            ),
        ).alias("beams"),
    )
    return finalise(rows, has_labels=False, remapping=None)


def order_features() -> E.FeatureSet:
    """Built-in features and two custom ones that share a step."""
    counted = E.Dependency("beam count", lambda df: df.withColumn("n_beams", F.size("beams").cast("double")))
    per_charge = E.CustomFeature(
        "beams per charge", ["beams_per_charge"],
        lambda df: df.withColumn("beams_per_charge", F.col("n_beams") / F.col("precursor_charge")), (counted,),
    )
    many = E.CustomFeature("beam count feature", ["n_beams"], lambda df: df, (counted,))
    return E.FeatureSet(E.MassError("da"), E.BeamStatistics(), E.TokenScores(), per_charge, many)


_VALUES = ["mass_error_da", "margin", "median_margin", "edit_distance", "min_token_probability",
           "std_token_probability", "beams_per_charge", "n_beams"]


@query(
    "feature_job_values",
    f"""WITH {ORDER_SQL} SELECT round(confidence, 4) AS confidence, correct, {", ".join(f"round({c}, 4) + 0e0 AS {c}" for c in _VALUES)}
        FROM feat""",
)
def feature_job_values(spark, d):
    """The training matrix that the feature job writes, over usable rows only."""
    path = f"{_folder(spark)}/matrix.parquet"
    jobs.compute_features(order_psms(spark, d), order_features(), matrix_path=path)
    return spark.read.parquet(path).select(rnd("confidence", digits=4), "correct", *[rnd(c, digits=4) for c in _VALUES])


@query(
    "feature_job_counters",
    f"""WITH {ORDER_SQL} SELECT count(*) AS n_rows, count(*) FILTER (len(p) < 2) AS n_short_beams,
        count(*) FILTER (length(seq) > 25) AS n_is_missing_length FROM feat""",
)
def feature_job_counters(spark, d):
    """Counters of missing inputs from the job that computes and stores the features."""
    flag = E.CustomFeature(
        "length", ["is_missing_length"], lambda df: df.withColumn("is_missing_length", F.size("prediction") > 25)
    )
    counters = Observation("missing inputs")
    features = E.FeatureSet(E.BeamStatistics(), flag)
    scale.store(jobs.compute_features(order_psms(spark, d), features, counters=counters))
    found = counters.get  # filled by the job above
    names = ["n_rows", "n_short_beams", "n_is_missing_length"]
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


_MODEL_INPUTS = ["mass_error_da", "margin", "min_token_probability", "beams_per_charge"]
_MODEL_MEAN, _MODEL_STD = [0.5, 0.0, 0.2, 0.5, 2.0], [0.3, 800.0, 0.2, 0.3, 1.5]
_MODEL_W1 = [[0.9, 0.1, 0.4, -0.2, 0.05], [-0.6, -0.3, 0.2, 0.5, 0.1]]


def _order_model() -> C.ProbabilityCalibrator:
    model = C.ProbabilityCalibrator(_MODEL_INPUTS, hidden_dims=(2,))
    model.mean, model.std = _MODEL_MEAN, _MODEL_STD
    model.weights = [np.array(_MODEL_W1), np.array([0.1, -0.2]), np.array([[1.1, -0.8]]), np.array([0.15])]
    return model


def _unit(row: list[float], bias: float) -> str:
    terms = [
        f"{w!r}::double * ({c} - {m!r}::double) / {s!r}::double"
        for w, c, m, s in zip(row, ["confidence", *_MODEL_INPUTS], _MODEL_MEAN, _MODEL_STD, strict=True)
    ]
    return f"greatest({' + '.join(terms)} + {bias!r}::double, 0e0)"


@query(
    "predict_job_values",
    f"""WITH {ORDER_SQL}, scored AS (
        SELECT l_orderkey, seq, 1e0 / (1e0 + exp(-(1.1::double * {_unit(_MODEL_W1[0], 0.1)}
          - 0.8::double * {_unit(_MODEL_W1[1], -0.2)} + 0.15::double))) AS p FROM feat),
        ranked AS (SELECT *, avg(1e0 - p) OVER (ORDER BY p DESC, l_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM scored),
        curve AS (SELECT p, min(run) AS fdr FROM ranked GROUP BY 1),
        qv AS (SELECT p, fdr, min(fdr) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS q FROM curve)
        SELECT cast(l_orderkey AS varchar) AS spectrum_id, replace(seq, 'L', 'I') AS prediction, round(p, 4) AS p, round(fdr, 4) AS fdr,
          round(q, 4) AS q, round(1e0 - p, 4) AS pep
        FROM scored JOIN qv USING (p) WHERE p >= (SELECT min(p) FROM curve WHERE fdr <= 0.3::double)""",
)
def predict_job_values(spark, d):
    """The prediction job over features it computes itself; its output table, row by row."""
    folder = _folder(spark)
    jobs.predict(order_psms(spark, d), _order_model(), order_features(), threshold=0.3, output_folder=folder)
    kept = spark.read.csv(f"{folder}/preds_and_fdr_metrics.csv", header=True, schema=None).selectExpr(
        "spectrum_id", "prediction", "cast(calibrated_confidence AS double) AS p", "cast(psm_fdr AS double) AS fdr",
        "cast(psm_q_value AS double) AS q", "cast(psm_pep AS double) AS pep",
    )
    return kept.select("spectrum_id", "prediction", *[rnd(c, digits=4) for c in ("p", "fdr", "q", "pep")])


# --- one synchronous training step, in closed form -----------------------------------------

_STEP_INPUTS, _STEP_RATE, _STEP_DECAY, _STEP_SEED = ["margin", "beams_per_charge"], 0.05, 0.0, 11


def _step_sql() -> str:
    """The first step moves each weight by rate * g / (|g| + 1e-8), g the mean gradient."""
    w, b = C.init_weights([3, 1], _STEP_SEED)
    names = ["confidence", *_STEP_INPUTS]
    mean = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1e0 END AS s_{c}" for c in names)
    x = ", ".join(f"({c} - m_{c}) / s_{c} AS x{i}" for i, c in enumerate(names))
    logit = " + ".join(f"{float(v)!r}::double * x{i}" for i, v in enumerate(w[0])) + f" + {float(b[0])!r}::double"
    error = "(1e0 / (1e0 + exp(-z)) - y)"
    grads = ", ".join(f"avg({error} * x{i}) AS g{i}" for i in range(3)) + f", avg({error}) AS g3"
    moved = [f"({float(v)!r}::double - {_STEP_RATE!r}::double * g{i} / (abs(g{i}) + 1e-8))" for i, v in enumerate([*w[0], b[0]])]
    after = " + ".join(f"{moved[i]} * x{i}" for i in range(3)) + f" + {moved[3]}"
    return f"""WITH {ORDER_SQL}, st AS (SELECT {mean} FROM feat),
        x AS (SELECT l_orderkey, CASE WHEN correct THEN 1e0 ELSE 0e0 END AS y, {x} FROM feat, st),
        z AS (SELECT *, {logit} AS z FROM x), g AS (SELECT {grads} FROM z)
        SELECT cast(l_orderkey AS varchar) AS spectrum_id, round(1e0 / (1e0 + exp(-({after}))), 4) AS p FROM x, g"""


@query("train_one_step", _step_sql())
def train_one_step(spark, d):
    """PSM rows -> features -> fit of a linear model by one step over all rows -> scores."""
    usable = jobs.compute_features(order_psms(spark, d), order_features())
    rows = scale.store(usable.select("spectrum_id", "confidence", "correct", *_STEP_INPUTS))
    model = C.ProbabilityCalibrator(
        _STEP_INPUTS, hidden_dims=(), dropout=0.0, learning_rate=_STEP_RATE, weight_decay=_STEP_DECAY, max_epochs=1,
        seed=_STEP_SEED, synchronous=True,
    )
    model.fit(rows)
    return model.predict(rows).select("spectrum_id", rnd("calibrated_confidence", "p", 4))


@query(
    "training_columns",
    f"WITH {ORDER_SQL} SELECT round(margin, 4) + 0e0 AS margin, round(n_beams, 4) AS n_beams FROM feat",
)
def training_columns(spark, d):
    """Model inputs narrowed to some of the computed columns, in the order asked for."""
    features = order_features()
    trained = jobs.train(
        order_psms(spark, d), features, training_feature_columns=["margin", "n_beams"], hidden_dims=(), max_epochs=1,
        synchronous=True,
    )
    picked = trained.model.inputs[1:]
    return trained.rows.select(*[rnd(c, digits=4) for c in picked])


# --- splits, band joins, candidates -----------------------------------------------------------

# Suppliers are experiments of very different size: a few hold most lines.
_GROUP = "l_suppkey % 40 * (l_suppkey % 3) % 23"


@query(
    "group_split",
    f"""WITH rows AS (SELECT {_GROUP} AS grp FROM lineitem),
        sizes AS (SELECT grp, count(*) AS n, md5('7:' || cast(grp AS varchar)) AS k FROM rows GROUP BY 1),
        running AS (SELECT *, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
          sum(n) OVER () AS total FROM sizes)
        SELECT cast(grp AS bigint) AS grp, n, before < 0.25::double * total AND before + n < total AS validation FROM running""",
)
def group_split(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.expr(_GROUP).alias("grp"))
    train, val = split.group_split(rows, "grp", 0.25, seed=7)
    sides = train.withColumn("validation", F.lit(False)).union(val.withColumn("validation", F.lit(True)))
    return sides.groupBy(F.col("grp").cast("long").alias("grp"), "validation").agg(F.count("*").alias("n")).select("grp", "n", "validation")


@query(
    "ion_match_band",
    f"""WITH {V.SPECTRUM_SQL}, {V.ION_SQL},
        peak AS (SELECT vec_id, 1e2 + 1e1 * i + (vec_id % 7) / 1e2 AS mz, h FROM spec)
        SELECT ion.vec_id, kind, num, round(peak.mz, 4) AS peak_mz, round(peak.h, 6) AS height
        FROM ion JOIN peak ON ion.vec_id = peak.vec_id AND ion.mz BETWEEN peak.mz - 0.04::double AND peak.mz + 0.04::double""",
)
def ion_match_band(spark, d):
    """All peaks within the tolerance of a predicted ion, as a join without a per-row loop."""
    peaks = V.spectra(spark, d).select("vec_id", F.explode(F.arrays_zip("mz_array", "intensity_array")).alias("x"))
    peaks = peaks.select("vec_id", (F.col("x.mz_array") + F.expr("(vec_id % 7) / 1e2")).alias("peak_mz"), F.col("x.intensity_array").alias("height"))
    ions = V.predicted_ions(spark, d).select(
        F.expr("cast(substring(spectrum_id, 3) AS bigint)").alias("vec_id"), F.col("mz").alias("ion_mz"),
        F.expr("substring(annotation, 1, 1)").alias("kind"), F.regexp_extract("annotation", r"(\d+)\+", 1).cast("long").alias("num"),
    )
    found = joins.band_join(ions, peaks, ["vec_id"], "ion_mz", "peak_mz", 0.04)
    return found.select("vec_id", "kind", "num", rnd("peak_mz", digits=4), rnd("height"))


@query(
    "candidate_chunks",
    """WITH placed AS (SELECT l_returnflag, l_quantity, l_orderkey, l_linenumber, row_number() OVER (
          PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber) - 1 AS place FROM lineitem)
        SELECT l_returnflag, place // 1000 AS chunk, count(*) AS n, arg_min(l_orderkey, place) AS first_key,
          arg_max(l_orderkey, place) AS last_key, cast(sum(l_linenumber * (place % 1000)) AS bigint) AS weighed
        FROM placed GROUP BY 1, 2""",
)
def candidate_chunks(spark, d):
    """Three keys hold all rows; their candidates come as numbered lists of at most a thousand."""
    lines = V.table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_orderkey", "l_linenumber")
    order = ["l_quantity", "l_orderkey", "l_linenumber"]
    lists = joins.candidate_chunks(lines, "l_returnflag", order, ["l_orderkey", "l_linenumber"], "c", size=1000)
    weighed = F.aggregate(
        F.transform("c", lambda x, i: x["l_linenumber"].cast("long") * i), F.lit(0).cast("long"), lambda a, b: a + b
    )
    return lists.select(
        "l_returnflag", "chunk", F.size("c").cast("long").alias("n"), F.col("c")[0]["l_orderkey"].alias("first_key"),
        F.element_at("c", -1)["l_orderkey"].alias("last_key"), weighed.alias("weighed"),
    )


@query(
    "top_k_hot_key",
    """SELECT l_returnflag, l_orderkey, l_linenumber, cast(row_number() OVER (PARTITION BY l_returnflag
          ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS integer) AS rank FROM lineitem QUALIFY rank <= 50""",
)
def top_k_hot_key(spark, d):
    lines = V.table(spark, d, "lineitem")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return joins.top_k_per_key(lines, "l_returnflag", order, 50).select("l_returnflag", "l_orderkey", "l_linenumber", "rank")


# --- checks, projections and custom parts ---------------------------------------------------------


@query(
    "first_offenders",
    """SELECT o_custkey AS key, 'duplicate' AS kind FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5)
        UNION ALL SELECT o_orderkey, 'orphan' FROM (SELECT o_orderkey FROM orders
          WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) ORDER BY 1 LIMIT 5)""",
)
def first_offenders(spark, d):
    """What the messages of failed key checks name."""
    orders = V.table(spark, d, "orders")
    lines = V.table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    twice = joins.first_offenders(joins.duplicate_keys(orders, "o_custkey"), "o_custkey")
    lost = joins.first_offenders(joins.orphan_keys(orders, lines, "o_orderkey"), "o_orderkey")
    return twice.select(F.col("o_custkey").alias("key"), F.lit("duplicate").alias("kind")).union(
        lost.select("o_orderkey", F.lit("orphan"))
    )


@query(
    "usable_predictions",
    f"WITH {ORDER_SQL} SELECT l_orderkey FROM psm",
)
def usable_predictions(spark, d):
    """Rows with tokens and a score: what missing scores and empty predictions leave."""
    return filters.usable_predictions(order_psms(spark, d)).select("l_orderkey")


@query(
    "model_input_projection",
    f"""WITH {ORDER_SQL} SELECT l_orderkey, 27 AS collision_energies, precursor_charge AS precursor_charges,
        'HCD' AS fragmentation_types FROM psm""",
)
def model_input_projection(spark, d):
    """Inputs of an external model from constants and from columns; automatic ones stay out."""
    rows = filters.usable_predictions(order_psms(spark, d))
    out = E.model_inputs(
        rows, ["peptide_sequences", "precursor_charges", "collision_energies", "fragmentation_types"], ["peptide_sequences"],
        constants={"collision_energies": 27, "fragmentation_types": "HCD"}, columns={"precursor_charges": "precursor_charge"},
    )
    return out.select("l_orderkey", "collision_energies", "precursor_charges", "fragmentation_types")


@query(
    "custom_fdr_method",
    f"""WITH {V.PSM_SQL}, c AS (SELECT confidence AS score, count(*) AS n, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS good FROM psm GROUP BY 1),
        r AS (SELECT score, n, (1e0 + sum(n - good) OVER w) / greatest(sum(good) OVER w, 1) AS fdr FROM c
              WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
        q AS (SELECT *, min(fdr) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS qv FROM r)
        SELECT spectrum_id, round(fdr, 6) AS psm_fdr, round(qv, 6) AS psm_q_value FROM psm JOIN q ON confidence = score
        WHERE confidence >= (SELECT min(score) FROM r WHERE fdr <= 0.9::double)""",
)
def custom_fdr_method(spark, d):
    """A method of one's own - incorrect rows, one added, per correct row - through the shared look-ups."""
    rows = V.psm(spark, d)
    counts = scale.materialise(
        rows.groupBy(F.col("confidence").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("good"))
    )
    n_rows = counts.count()
    order = [F.col("score").desc()]
    sums = {"_good": F.col("good"), "_bad": F.col("n") - F.col("good")}
    placed = scale.running_totals(scale.order_buckets(counts, order, n_rows), order, sums, n_rows, inclusive=True)
    rate = (F.lit(1.0) + F.col("_bad")) / F.greatest("_good", F.lit(1))
    curve = fdr.curve_from_points(placed.withColumns({"psm_fdr": rate, "low_fdr": rate}), n_rows)
    out = fdr.control_fdr(rows, "confidence", 0.9, curve)
    return out.select("spectrum_id", rnd("psm_fdr"), rnd("psm_q_value"))


# --- data sources and loaders by name ----------------------------------------------------------


def _mztab_text(spark: SparkSession, folder: str, path: str) -> None:
    """Lines of all orders as the PSM section of one mzTab data set, with other sections around."""
    cand = V.candidates(spark, folder)
    psm = cand.select(
        F.concat_ws("\t", F.lit("PSM"), "seq", F.col("l_orderkey").cast("string"),
                    F.when(F.col("l_linenumber") % 5 == 0, F.lit("null")).otherwise(F.col("prob").cast("string"))).alias("value")
    )
    head = spark.createDataFrame([("MTD\tmzTab-version\t1.0.0",), ("PSH\tsequence\tPSM_ID\tscore",), ("COM\tPSM\tno row",)], "value string")
    head.coalesce(1).unionByName(psm).write.text(path)


@query(
    "mztab_source",
    f"""WITH {V.CANDIDATE_SQL} SELECT cast(l_orderkey AS varchar) AS "PSM_ID", count(*) AS n, count(*) FILTER (l_linenumber % 5 <> 0) AS scored,
        round(sum(CASE WHEN l_linenumber % 5 = 0 THEN 0e0 ELSE prob END), 6) AS total, max(seq) AS highest FROM cand GROUP BY 1""",
)
def mztab_source(spark, d):
    """mzTab by ``spark.read.format``, in partitions of byte ranges."""
    path = f"{_folder(spark)}/psms.mztab"
    _mztab_text(spark, d, path)
    loaders.register_sources(spark)
    rows = spark.read.format("psm-mztab").option("splitBytes", 500_000).load(path)
    score = F.col("score").cast("double")
    return rows.groupBy("PSM_ID").agg(
        F.count("*").alias("n"), F.count("score").alias("scored"),
        F.round(F.coalesce(F.sum(score), F.lit(0.0)), 6).alias("total"), F.max("sequence").alias("highest"),
    )


@query(
    "loader_by_name",
    f"""WITH {V.PART_SQL} SELECT p_partkey, replace(seq, 'L', 'I') AS prediction, length(seq) > 0 AND p_partkey % 4 <> 0 AS valid_prediction FROM pep""",
)
def loader_by_name(spark, d):
    """A loader of one's own, registered and used by name; every fourth score is missing."""
    if "parts" not in loaders.LOADERS:

        @loaders.loader("parts")
        def load(spark, data_path, predictions_path=None, missing=4):
            rows = V.part_peptides(spark, data_path)
            score = F.when(F.col("p_partkey") % missing != 0, F.lit(0.5))
            return finalise(rows.withColumn("confidence", score), has_labels=False, remapping=None)

    out = loaders.load_psms(spark, "parts", d)
    text = F.coalesce(F.array_join("prediction", ""), F.lit(""))
    return out.select("p_partkey", text.alias("prediction"), "valid_prediction")


@query(
    "saved_csv_types",
    """SELECT doc_id, md5(text) AS note, 'bigint' AS big_type, doc_id * 1000003 + 9007199254740993 AS big, 'string' AS code_type,
          lpad(cast(doc_id % 1000 AS varchar), 5, '0') AS code, 'boolean' AS flag_type, doc_id % 3 = 0 AS flag,
          round(n_chars / 7e0, 4) AS ratio, 3 AS n_peaks FROM documents""",
)
def saved_csv_types(spark, d):
    """Text with line breaks and quotes, long numbers, codes, booleans and lists through CSV in small splits."""
    path = f"{_folder(spark)}/typed.csv"
    docs = V.table(spark, d, "documents")
    rows = docs.select(
        "doc_id", F.col("text").alias("title"), (F.col("doc_id") * 1000003 + F.lit(9007199254740993)).alias("big"),
        F.lpad((F.col("doc_id") % 1000).cast("string"), 5, "0").alias("code"), (F.col("doc_id") % 3 == 0).alias("flag"),
        F.round(F.col("n_chars") / 7, 4).alias("ratio"), F.lit("[1. 2.5 3.]").alias("mz_array"),
        F.lit("PEPTIDE").alias("prediction"), F.lit(0.5).alias("confidence"),
    )
    # Several files, of one split of the input each where it has several.
    dealt = rows if rows.rdd.getNumPartitions() >= 3 else rows.repartition(3)
    dealt.write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    out = saved.load_saved(spark, path)
    kinds = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    return out.select(
        "doc_id", F.md5("title").alias("note"), F.lit(kinds["big"]).alias("big_type"), "big", F.lit(kinds["code"]).alias("code_type"),
        "code", F.lit(kinds["flag"]).alias("flag_type"), "flag", F.round("ratio", 4).alias("ratio"), F.size("mz_array").alias("n_peaks"),
    )


@query(
    "chimeric_runner_up",
    f"""WITH {_BUNDLE}, full_row AS (SELECT concat('v:', vec_id) AS spectrum_id, vec_id,
          {_BUNDLE_COLUMNS.format(p='chimeric_')}
          FROM base JOIN total USING (vec_id) LEFT JOIN series USING (vec_id) LEFT JOIN pairs USING (vec_id)
          LEFT JOIN gap USING (vec_id) JOIN xc USING (vec_id))
        SELECT spectrum_id, vec_id % 8 >= 6 OR vec_id % 3 = 0 AS is_missing_chimeric_features, {", ".join(
            f"CASE WHEN vec_id % 8 < 6 AND vec_id % 3 <> 0 THEN chimeric_{c} ELSE 0 END AS chimeric_{c}" for c in N.ION_FEATURES)}
        FROM full_row""",
)
def chimeric_runner_up(spark, d):
    """The second candidate decides: every third is too long for the model, the first always is."""
    def beam(tokens):
        return F.struct(tokens.alias("sequence"), F.lit(-1.0).alias("log_prob"), F.lit(None).cast("array<double>").alias("token_log_probs"))

    first = F.array_repeat(F.lit("G"), 40)
    second = F.array_repeat(F.lit("A"), F.when(F.col("vec_id") % 3 == 0, 35).otherwise(20))
    rows = _fragment_rows(spark, d).withColumns({"prediction": first, "beams": F.array(beam(first), beam(second))})
    out = E.FragmentMatch(V.predicted_ions(spark, d), 0.02, "da", runner_up=True)(rows)
    return _fragment_output(out, "chimeric_", "is_missing_chimeric_features")
