"""Registered queries: peptide functions, features, spectra, joins, proteome, model."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafdr.constants import (
    BEAM_CSV_REMAPPING,
    H2O_MASS,
    PROTON_MASS,
    RESIDUE_MASSES,
    TITLE_TSV_NTERM_MODS,
)
from spectrafdr.functions import peptides as P
from spectrafdr.functions import scores as S
from spectrafdr.functions import spectra as N
from spectrafdr.operators import features as E
from spectrafdr.operators import filters, joins, proteome, scale
from spectrafdr.operators.calibrator import ProbabilityCalibrator
from spectrafdr.plans import jobs
from spectrafdr.workload import views as V
from spectrafdr.workload.registry import query, rnd

MASS_SQL = "MAP {" + ", ".join(
    f"'{k}': {v!r}::double" for k, v in RESIDUE_MASSES.items() if len(k) == 1
) + "}"


# --- peptide strings ------------------------------------------------------------

_REMAP_SQL = "CASE t WHEN 'L' THEN 'I' " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in BEAM_CSV_REMAPPING.items()
) + " ELSE t END"
_TOKENS_SQL = (
    r"regexp_extract_all(raw, '\[[^\]]+\]|\([^)]+\)|[A-Z](?:\[[^\]]+\]|\([^)]+\)|[+-]?\d*\.\d+)?"
    r"|[+-]\d*\.\d+')"
)


@query(
    "peptide_normalise",
    f"""WITH {V.PART_SQL}, raw AS (SELECT p_partkey, {V.NOTATION_CASE} AS raw FROM pep),
        tok AS (SELECT p_partkey, raw, list_transform({_TOKENS_SQL}, lambda t: {_REMAP_SQL}) AS t FROM raw)
        SELECT p_partkey, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens,
          replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\([^)]*\\)-?', '', 'g'),
            '\\[[^\\]]*\\]-?', '', 'g'), '[+-]?\\d+(?:\\.\\d+)?-?', '', 'g'), 'I', 'L') AS stripped,
          CASE WHEN len(t) > 1 AND NOT regexp_matches(t[1], '^[A-Za-z]')
                 THEN concat(t[1], '-', array_to_string(t[2:], ''))
               WHEN len(t) > 1 AND NOT regexp_matches(t[-1], '^[A-Za-z]')
                 THEN concat(array_to_string(t[:-2], ''), '-', t[-1])
               ELSE array_to_string(t, '') END AS proforma
        FROM tok""",
)
def peptide_normalise(spark, d):
    raw = (
        V.table(spark, d, "part")
        .select("p_partkey", V.letters().alias("seq"))
        .select("p_partkey", F.expr(V.NOTATION_CASE).alias("raw"))
    )
    tokens = P.normalise_peptide(F.col("raw"), False, BEAM_CSV_REMAPPING)
    return raw.withColumn("t", tokens).select(
        "p_partkey",
        F.size("t").cast("long").alias("n_tokens"),
        F.array_join("t", " ").alias("tokens"),
        P.stripped_for_match(F.col("raw")).alias("stripped"),
        P.proforma(F.col("t")).alias("proforma"),
    )


@query(
    "residue_matches",
    f"""WITH {V.PART_SQL},
        pair AS (SELECT p_partkey, string_split(seq, '') AS a,
                        string_split(concat(substr(seq, 1, 3), reverse(substr(seq, 4))), '') AS b FROM pep),
        la AS (SELECT p_partkey, i, {MASS_SQL}[a[i]] AS m,
                 sum({MASS_SQL}[a[i]]) OVER (PARTITION BY p_partkey ORDER BY i) AS c
               FROM (SELECT p_partkey, a, unnest(range(1, len(a) + 1)) AS i FROM pair)),
        lb AS (SELECT p_partkey, i, {MASS_SQL}[b[i]] AS m,
                 sum({MASS_SQL}[b[i]]) OVER (PARTITION BY p_partkey ORDER BY i) AS c
               FROM (SELECT p_partkey, b, unnest(range(1, len(b) + 1)) AS i FROM pair)),
        hit AS (SELECT la.p_partkey, count(*) AS n FROM la JOIN lb ON la.p_partkey = lb.p_partkey
                AND abs(la.c - lb.c) < 5e-1 AND abs(la.m - lb.m) < 1e-1 GROUP BY 1)
        SELECT p_partkey, coalesce(n, 0) AS num_matches, coalesce(n, 0) = len(a) AS correct
        FROM pair LEFT JOIN hit USING (p_partkey)""",
)
def residue_matches(spark, d):
    """A label against a prediction whose tail is reversed: same mass, some matches."""
    seq = V.letters()
    rows = V.table(spark, d, "part").select(
        "p_partkey",
        P.tokenise(seq).alias("sequence"),
        P.tokenise(F.concat(F.substring(seq, 1, 3), F.reverse(F.substr(seq, F.lit(4))))).alias(
            "prediction"
        ),
    )
    n = P.residue_matches(F.col("sequence"), F.col("prediction"))
    return rows.withColumn("num_matches", n).select(
        "p_partkey",
        F.col("num_matches").cast("long").alias("num_matches"),
        P.is_correct(
            F.col("num_matches"), F.col("sequence"), F.col("prediction"), F.lit(True)
        ).alias("correct"),
    )


_MOD_RAW = """CASE p_partkey % 5 WHEN 0 THEN concat('[+42.011]', p_name) WHEN 1 THEN concat(p_name, '[-17.027]')
  WHEN 2 THEN concat('[+43.006]', p_name, '[+43.006]') WHEN 3 THEN concat('[+43.006-17.027]', p_name)
  ELSE p_name END"""


@query(
    "misplaced_mods",
    f"""SELECT p_partkey FROM (SELECT p_partkey, {_MOD_RAW} AS raw FROM part)
        WHERE NOT ({" OR ".join(f"strpos(substr(raw, 2), '{m}') > 0" for m in TITLE_TSV_NTERM_MODS)})""",
)
def misplaced_mods(spark, d):
    rows = V.table(spark, d, "part").selectExpr("p_partkey", f"{_MOD_RAW} AS raw")
    bad = P.misplaced_terminal_mod(F.col("raw"), TITLE_TSV_NTERM_MODS)
    return filters.drop_where(rows, bad).select("p_partkey")


@query(
    "score_conversions",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(p, 6) AS probability,
         round(ln(p), 6) AS log_prob FROM (
         SELECT *, greatest(CASE WHEN l_tax - l_discount < 0 THEN l_tax - l_discount + 1
                                 ELSE l_tax - l_discount END, 1e-10) AS p FROM lineitem)""",
)
def score_conversions(spark, d):
    """Penalised score (negative = one subtracted) -> probability -> log-probability."""
    rows = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.expr("l_tax - l_discount").alias("s"),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.probability_from_penalised(F.col("s")).alias("probability"),
        S.log_from_penalised(F.col("s")).alias("log_prob"),
    ).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd("probability"), rnd("log_prob")
    )


# --- column features --------------------------------------------------------------

_THEORY = f"""(list_sum(list_transform(string_split(seq, ''), lambda c: {MASS_SQL}[c])) + {H2O_MASS!r}::double
  + precursor_charge * {PROTON_MASS!r}::double) / precursor_charge"""
_MASS = f"""WITH {V.PART_SQL}, t AS (SELECT *, {_THEORY} AS theory FROM pep),
  c AS (SELECT p_partkey, precursor_charge AS z, precursor_mz AS mz, i,
          theory - (precursor_mz - i * 1.00335::double / precursor_charge) AS delta
        FROM t, range(0, 2) r(i)),
  best AS (SELECT p_partkey, arg_min(struct_pack(ppm := delta / mz * 1e6, da := delta * z),
             abs(delta / mz * 1e6) + i * 1e-12) AS b FROM c GROUP BY 1)"""


@query("mass_error_ppm", f"{_MASS} SELECT p_partkey, round(b.ppm, 3) + 0e0 AS mass_error_ppm FROM best")
def mass_error_ppm(spark, d):
    out = E.MassError("ppm")(V.part_peptides(spark, d))
    return out.select("p_partkey", rnd("mass_error_ppm", digits=3))


@query("mass_error_da", f"{_MASS} SELECT p_partkey, round(b.da, 3) + 0e0 AS mass_error_da FROM best")
def mass_error_da(spark, d):
    out = E.MassError("da")(V.part_peptides(spark, d))
    return out.select("p_partkey", rnd("mass_error_da", digits=3))


@query(
    "sequence_features",
    f"WITH {V.PART_SQL} SELECT p_partkey, length(seq) AS sequence_length, precursor_charge FROM pep",
)
def sequence_features(spark, d):
    out = E.SequenceLength()(V.part_peptides(spark, d))
    return out.select(
        "p_partkey", F.col("sequence_length").cast("long").alias("sequence_length"), "precursor_charge"
    )


@query(
    "beam_features",
    f"""WITH {V.BEAM_SQL}, r AS (
        SELECT *, CASE WHEN len(p) >= 2 THEN p[2:] ELSE [0e0] END AS q,
          list_sum(p) / len(p) AS mu FROM beam),
        x AS (SELECT *, list_sum(q) AS tot,
          sqrt(list_sum(list_transform(p, lambda v: (v - mu) * (v - mu))) / len(p)) AS sd,
          replace(s[1], 'L', 'I') AS a, replace(s[2], 'L', 'I') AS b FROM r)
        SELECT l_orderkey, round(p[1] - coalesce(p[2], 0e0), 6) + 0e0 AS margin,
          round(p[1] - list_median(q), 6) + 0e0 AS median_margin,
          round(CASE WHEN tot = 0 THEN 0e0 ELSE list_sum(list_transform(q,
            lambda v: CASE WHEN v > 0 THEN -(v / tot) * ln(v / tot) ELSE 0e0 END)) END, 6) + 0e0 AS entropy,
          round(CASE WHEN sd < 1e-12 THEN 0e0 ELSE (p[1] - mu) / sd END, 6) + 0e0 AS z_score,
          round(CASE WHEN len(p) < 2 THEN 1e0
            ELSE levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS edit_distance
        FROM x""",
)
def beam_features(spark, d):
    out = E.BeamStatistics()(V.beams(spark, d))
    # Equal probabilities leave rounding noise of 1e-17 as deviation on either engine.
    p = F.transform("beams", lambda b: F.exp(b["log_prob"]))
    flat = (F.array_max(p) - F.array_min(p)) < 1e-12
    return out.withColumn("z_score", F.when(flat, 0.0).otherwise(F.col("`z-score`"))).select(
        "l_orderkey", rnd("margin"), rnd("median_margin"), rnd("entropy"), rnd("z_score"),
        rnd("edit_distance"),
    )


@query(
    "token_scores",
    """WITH p AS (SELECT l_orderkey, list(1e0 - l_tax) AS p FROM lineitem GROUP BY 1),
        m AS (SELECT *, list_sum(p) / len(p) AS mu FROM p)
        SELECT l_orderkey, round(list_min(p), 6) AS min_token_probability,
          round(sqrt(list_sum(list_transform(p, lambda v: (v - mu) * (v - mu))) / len(p)), 6)
            AS std_token_probability FROM m""",
)
def token_scores(spark, d):
    rows = (
        V.table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.collect_list(F.log(F.expr("1e0 - l_tax"))).alias("logs"))
        .select(
            "l_orderkey",
            F.array(
                F.struct(
                    F.array(F.lit("A")).alias("sequence"),
                    F.lit(0.0).alias("log_prob"),
                    F.col("logs").alias("token_log_probs"),
                )
            ).alias("beams"),
        )
    )
    out = E.TokenScores()(rows)
    return out.select("l_orderkey", rnd("min_token_probability"), rnd("std_token_probability"))


@query(
    "model_support",
    f"""WITH {V.PART_SQL} SELECT p_partkey,
        length(seq) BETWEEN 1 AND 10 AND precursor_charge <= 3 AND NOT contains(seq, 'W') AS supported FROM pep""",
)
def model_support(spark, d):
    """Which peptides a spectrum model accepts: length, charge, unsupported tokens."""
    ok = filters.model_supports(
        F.col("prediction"), 10, ["W"], F.col("precursor_charge"), 3
    )
    return V.part_peptides(spark, d).select("p_partkey", ok.alias("supported"))


@query(
    "missing_counts",
    f"""WITH {V.BEAM_SQL} SELECT count(*) AS n_rows, count(*) FILTER (len(p) < 2) AS n_short_beams,
        count(*) FILTER (l_orderkey % 5 = 0) AS n_is_missing_x FROM beam""",
)
def missing_counts(spark, d):
    rows = V.beams(spark, d).withColumn("is_missing_x", F.col("l_orderkey") % 5 == 0)
    return E.missing_counts(rows)


# --- grouped candidates -------------------------------------------------------------


@query(
    "top1_per_key",
    f"""WITH {V.CANDIDATE_SQL} SELECT l_orderkey, round(prob, 6) AS prob, seq FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY prob DESC, seq) AS rn FROM cand)
        WHERE rn = 1""",
)
def top1_per_key(spark, d):
    rows = V.candidates(spark, d).select("l_orderkey", "prob", "seq")
    out = joins.top_per_key(rows, "l_orderkey", [-F.col("prob"), F.col("seq")])
    return out.select("l_orderkey", rnd("prob"), "seq")


@query(
    "ranked_candidates",
    f"""WITH {V.BEAM_SQL} SELECT l_orderkey, array_to_string(s, '|') AS seqs,
        array_to_string(list_transform(p, lambda v: cast(round(v * 10) AS integer)), ',') AS ranks FROM beam""",
)
def ranked_candidates(spark, d):
    rows = V.candidates(spark, d).filter("prob > 0")
    out = joins.candidates_per_key(
        rows, "l_orderkey", [-F.col("prob"), F.col("seq")], [F.col("seq"), F.col("prob")], "c"
    )
    return out.select(
        "l_orderkey",
        F.array_join(F.transform("c", lambda x: x["seq"]), "|").alias("seqs"),
        F.array_join(
            F.transform("c", lambda x: F.round(x["prob"] * 10).cast("int").cast("string")), ","
        ).alias("ranks"),
    )


# --- retention time -----------------------------------------------------------------

_IRT = f"""{V.PSM_SQL}, irt AS (SELECT DISTINCT peptide, ((user_id * 37) % 1000) / 1e1 AS irt FROM psm),
  row AS (SELECT p.*, i.irt, row_number() OVER w AS rk, count(*) OVER (PARTITION BY experiment_name) AS n
          FROM psm p JOIN irt i USING (peptide)
          WINDOW w AS (PARTITION BY experiment_name ORDER BY confidence DESC, spectrum_id)),
  train AS (SELECT * FROM row WHERE rk <= greatest(1, floor(0.1::double * n))),
  reg AS (SELECT experiment_name, regr_slope(irt, retention_time) AS slope,
            regr_intercept(irt, retention_time) AS intercept, count(*) AS n_train,
            count(DISTINCT peptide) AS n_peptides FROM train GROUP BY 1)"""


def _irt_inputs(spark, d):
    rows = V.psm(spark, d).withColumn("prediction", F.split("peptide", ""))
    irt = V.psm(spark, d).select(
        "peptide", F.expr("((user_id * 37) % 1000) / 1e1").alias("irt")
    ).distinct()
    return rows, irt


@query("top_fraction", f"WITH {_IRT} SELECT experiment_name, spectrum_id FROM train")
def top_fraction(spark, d):
    rows = V.psm(spark, d).select("experiment_name", "spectrum_id", "confidence")
    return E.top_fraction(rows, "experiment_name", "confidence", "spectrum_id", 0.1).select(
        "experiment_name", "spectrum_id"
    )


@query(
    "irt_regressors",
    f"""WITH {_IRT} SELECT experiment_name, n_train, n_peptides, round(slope * 1e6, 4) + 0e0 AS slope_e6,
        round(intercept, 4) AS intercept FROM reg""",
)
def irt_regressors(spark, d):
    rows, irt = _irt_inputs(spark, d)
    fitted = E.RetentionTime(irt).fit(rows)
    return fitted.withColumn("slope_e6", F.col("slope") * 1e6).select(
        "experiment_name", "n_train", "n_peptides", rnd("slope_e6", digits=4),
        rnd("intercept", digits=4),
    )


@query(
    "irt_regression",
    f"""WITH {_IRT} SELECT spectrum_id, round(irt, 4) AS irt,
        round(slope * retention_time + intercept, 4) AS predicted_irt,
        round(abs(slope * retention_time + intercept - irt), 4) AS irt_error
        FROM row JOIN reg USING (experiment_name)""",
)
def irt_regression(spark, d):
    rows, irt = _irt_inputs(spark, d)
    out = E.RetentionTime(irt)(rows)
    return out.select(
        "spectrum_id", rnd("iRT", "irt", 4), rnd("predicted iRT", "predicted_irt", 4),
        rnd("irt_error", digits=4),
    )


# --- joins ---------------------------------------------------------------------------


@query(
    "spectrum_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_custkey, o_totalprice
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def spectrum_join(spark, d):
    """Predictions (lines) of spectra (orders); hot keys are salted by measured counts."""
    spectra = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice"
    )
    lines = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    return joins.join_spectra(lines, spectra, "l_orderkey")


@query(
    "orphan_check",
    """SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem)
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def orphan_check(spark, d):
    orders = V.table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return joins.orphan_keys(
        V.table(spark, d, "lineitem"), orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey"
    )


@query(
    "duplicate_check",
    "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_check(spark, d):
    return joins.duplicate_keys(V.table(spark, d, "lineitem"), "l_orderkey")


# --- proteome ---------------------------------------------------------------------------


@query(
    "proteome_hits",
    f"""WITH {V.PROTEIN_SQL}, {V.PEPTIDE_SQL},
        u AS (SELECT DISTINCT replace(pep, 'I', 'L') AS p FROM pept),
        hit AS (SELECT p, count(*) FILTER (contains(hay, p)) > 0 AS h FROM u, prot WHERE length(p) > 0 GROUP BY 1)
        SELECT item_id, cast(k AS integer) AS k, cast(pos AS integer) AS pos, coalesce(h, false) AS proteome_hit
        FROM pept LEFT JOIN hit ON p = replace(pep, 'I', 'L') WHERE length(pep) >= 7""",
)
def proteome_hits(spark, d):
    psms = V.benchmark_peptides(spark, d).withColumn("prediction", P.tokenise(F.col("pep")))
    out = proteome.annotate_hits(psms, V.proteins(spark, d))
    return out.select("item_id", "k", "pos", "proteome_hit")


@query(
    "annotation_counts",
    """SELECT count(*) AS num_input, count(*) FILTER (n < 10) AS num_removed_short,
         count(*) FILTER (n >= 10) AS num_kept
       FROM (SELECT length(regexp_replace(upper(p_name), '[^GASPVTCLINDQKEMHFRYWUO]', '', 'g')) AS n FROM part)""",
)
def annotation_counts(spark, d):
    return proteome.annotation_counts(V.part_peptides(spark, d), 10)


@query(
    "fdr_proxy_label",
    f"""WITH {V.PROTEIN_SQL}, {V.PEPTIDE_SQL},
        u AS (SELECT DISTINCT replace(pep, 'I', 'L') AS p FROM pept),
        hit AS (SELECT p, count(*) FILTER (contains(hay, p)) > 0 AS h FROM u, prot WHERE length(p) > 0 GROUP BY 1),
        s AS (SELECT item_id, k, pos, coalesce(h, false) AS y, ((item_id * 131 + pos * 17 + k * 3) % 97) / 97e0 AS c
              FROM pept LEFT JOIN hit ON p = replace(pep, 'I', 'L') WHERE length(pep) >= 7),
        r AS (SELECT c, row_number() OVER w AS n, 1e0 - avg(CASE WHEN y THEN 1e0 ELSE 0e0 END) OVER (
                ORDER BY c DESC, y, item_id, k, pos ROWS UNBOUNDED PRECEDING) AS run
              FROM s WINDOW w AS (ORDER BY c DESC, y, item_id, k, pos))
        SELECT round(c, 6) AS score, round(arg_min(run, n), 6) AS fdr FROM r WHERE n > 10 GROUP BY c""",
)
def fdr_proxy_label(spark, d):
    """Label-based curve on a proxy label: the database hit."""
    from spectrafdr.operators import fdr

    psms = V.benchmark_peptides(spark, d).withColumn("prediction", P.tokenise(F.col("pep")))
    hits = proteome.annotate_hits(psms, V.proteins(spark, d)).withColumn(
        "confidence", F.expr("((item_id * 131 + pos * 17 + k * 3) % 97) / 97e0")
    )
    curve = fdr.fit_label_based(hits, "confidence", correct="proteome_hit", drop=10)
    return curve.points.select(rnd("score"), rnd("psm_fdr", "fdr"))


# --- spectra ----------------------------------------------------------------------------


@query(
    "ions_to_arrays",
    f"""WITH {V.SPECTRUM_SQL}, {V.ION_SQL} SELECT concat('v:', vec_id) AS spectrum_id, count(*) AS n,
        string_agg(concat(kind, num, '+1'), ',' ORDER BY mz) AS annotations,
        round(sum(mz * rk), 6) AS weighted FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY mz) AS rk FROM ion) GROUP BY 1""",
)
def ions_to_arrays(spark, d):
    out = E.ions_to_arrays(V.predicted_ions(spark, d))
    weighted = P.array_sum(F.transform("mz", lambda m, i: m * (i + 1)))
    return out.select(
        "spectrum_id",
        F.size("mz").cast("long").alias("n"),
        F.array_join("annotation", ",").alias("annotations"),
        F.round(weighted, 6).alias("weighted"),
    )


@query(
    "spectral_angle",
    """WITH c AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(x::double)) AS e FROM embeddings),
       f AS (SELECT label, arg_min(e, vec_id) AS e FROM c GROUP BY 1)
       SELECT vec_id, round(1 - 2 * acos(least(1e0, greatest(-1e0,
         list_sum(list_transform(range(1, 65), lambda i: c.e[i] * f.e[i]))
         / (sqrt(list_sum(list_transform(c.e, lambda x: x * x))) * sqrt(list_sum(list_transform(f.e, lambda x: x * x))))
       ))) / pi(), 5) + 0e0 AS angle FROM c JOIN f USING (label)""",
)
def spectral_angle(spark, d):
    """Each spectrum against the first spectrum of its label."""
    rows = V.spectra(spark, d).select("vec_id", "label", "intensity_array")
    first = rows.groupBy("label").agg(F.min_by("intensity_array", "vec_id").alias("first"))
    out = scale.attach(rows, first, "label", how="inner").withColumn(
        "angle", N.spectral_angle(F.col("first"), F.col("intensity_array"))
    )
    return out.select("vec_id", rnd("angle", digits=5))


_HIT = f"""{V.SPECTRUM_SQL}, {V.ION_SQL}, total AS (SELECT vec_id, sum(h) AS tot FROM spec GROUP BY 1),
  hit AS (SELECT *, (vec_id + i) % 3 <> 0 AS ok FROM ion)"""


@query(
    "ion_match",
    f"""WITH {_HIT} SELECT concat('v:', vec_id) AS spectrum_id,
        round(avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END), 6) AS match_rate,
        round(sum(CASE WHEN ok THEN h ELSE 0e0 END) / any_value(tot), 6) AS match_intensity,
        string_agg(CASE WHEN ok THEN concat(kind, num, '+1') END, ',' ORDER BY mz) AS annotations,
        count(*) FILTER (ok) AS n_matched
        FROM hit JOIN total USING (vec_id) GROUP BY vec_id""",
)
def ion_match(spark, d):
    ions = E.ions_to_arrays(V.predicted_ions(spark, d))
    rows = V.spectra(spark, d).join(ions, "spectrum_id")
    matched = N.matched_ions(
        F.col("mz"), F.col("annotation"), F.col("mz_array"), F.col("intensity_array"), 0.02, "da"
    )
    return rows.select("spectrum_id", matched.alias("m")).select("spectrum_id", "m.*").select(
        "spectrum_id", rnd("match_rate"), rnd("match_intensity"),
        F.array_join("annotations", ",").alias("annotations"),
        F.size("mz").cast("long").alias("n_matched"),
    )


# Fast cross-correlation in long form. 64 peaks end at m/z 730: 730 bins, windows of 73.
_XCORR = f"""{_HIT},
  obs AS (SELECT vec_id, cast(floor((1e2 + 1e1 * i) / 1.0005079::double + 0.4::double) AS bigint) AS b,
            max(sqrt(h)) AS v FROM spec GROUP BY 1, 2),
  size AS (SELECT vec_id, max(b) + 1 AS n FROM obs GROUP BY 1),
  win AS (SELECT o.*, least(b // (n // 10), 9) AS w FROM obs o JOIN size USING (vec_id)),
  norm AS (SELECT vec_id, b, CASE WHEN max(v) OVER (PARTITION BY vec_id, w) > 0
             THEN v * 5e1 / max(v) OVER (PARTITION BY vec_id, w) ELSE v END AS v FROM win),
  theo AS (SELECT DISTINCT vec_id, cast(floor(mz / 1.0005079::double + 0.4::double) AS bigint) AS b FROM ion),
  part AS (SELECT t.vec_id, t.b,
             sum(CASE WHEN o.b = t.b THEN o.v ELSE 0e0 END) AS own, sum(o.v) AS around
           FROM theo t JOIN norm o ON o.vec_id = t.vec_id AND o.b BETWEEN t.b - 75 AND t.b + 75
           GROUP BY 1, 2),
  xc AS (SELECT vec_id, sum(own - (around - own) / 15e1) AS xcorr FROM part GROUP BY 1)"""


@query(
    "xcorr",
    f"WITH {_XCORR} SELECT concat('v:', vec_id) AS spectrum_id, round(xcorr, 4) + 0e0 AS xcorr FROM xc",
)
def xcorr(spark, d):
    ions = E.ions_to_arrays(V.predicted_ions(spark, d))
    rows = V.spectra(spark, d).join(ions, "spectrum_id")
    score = N.xcorr(F.col("mz_array"), F.col("intensity_array"), F.col("mz"))
    return rows.select("spectrum_id", score.alias("xcorr")).select(
        "spectrum_id", rnd("xcorr", digits=4)
    )


_BUNDLE = f"""{_XCORR},
  run AS (SELECT vec_id, kind, count(*) AS len FROM (
            SELECT vec_id, kind, num - row_number() OVER (PARTITION BY vec_id, kind ORDER BY num) AS g
            FROM hit WHERE ok) GROUP BY vec_id, kind, g),
  series AS (SELECT vec_id, max(CASE WHEN kind = 'b' THEN len ELSE 0 END) AS lb,
               max(CASE WHEN kind = 'y' THEN len ELSE 0 END) AS ly FROM run GROUP BY 1),
  pairs AS (SELECT a.vec_id, count(*) AS n FROM hit a JOIN hit b ON a.vec_id = b.vec_id AND a.ok AND b.ok
            AND a.kind = 'b' AND b.kind = 'y' AND a.num + b.num = 20 GROUP BY 1),
  gap AS (SELECT vec_id, max(g) AS g FROM (SELECT vec_id,
            mz - lag(mz) OVER (PARTITION BY vec_id ORDER BY mz) AS g FROM hit WHERE ok) GROUP BY 1),
  base AS (SELECT vec_id, avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END) AS rate,
             sum(CASE WHEN ok THEN h ELSE 0e0 END) AS got,
             sum(CASE WHEN ok AND kind = 'b' THEN h ELSE 0e0 END)
               / (sum(CASE WHEN ok AND kind = 'y' THEN h ELSE 0e0 END) + 1e-8) AS ratio,
             1 - 2 * acos(least(1e0, sum(CASE WHEN ok THEN h ELSE 0e0 END * intensity)
               / (sqrt(sum(intensity * intensity)) * sqrt(sum(CASE WHEN ok THEN h * h ELSE 0e0 END)))))
               / pi() AS angle FROM hit GROUP BY 1)"""
_BUNDLE_COLUMNS = """round(rate, 6) AS {p}ion_matches, round(got / tot, 6) AS {p}ion_match_intensity,
  lb AS {p}longest_b_series, ly AS {p}longest_y_series, coalesce(pairs.n, 0) AS {p}complementary_ion_count,
  round(g, 6) AS {p}max_ion_gap, round(ratio, 5) AS {p}b_y_intensity_ratio,
  round(angle, 5) + 0e0 AS {p}spectral_angle, round(xcorr, 4) + 0e0 AS {p}xcorr"""


def _fragment_rows(spark, d):
    twenty = F.array_repeat(F.lit("A"), 20)
    charge = F.expr("cast(1 + vec_id % 8 AS int)")
    beam = F.struct(
        twenty.alias("sequence"), F.lit(-1.0).alias("log_prob"),
        F.lit(None).cast("array<double>").alias("token_log_probs"),
    )
    return V.spectra(spark, d).select(
        "spectrum_id", "vec_id", "mz_array", "intensity_array",
        charge.alias("precursor_charge"), twenty.alias("prediction"),
        F.array(beam, beam).alias("beams"),
    )


def _fragment_output(out, prefix, flag):
    longs = [prefix + c for c in ("longest_b_series", "longest_y_series", "complementary_ion_count")]
    digits = {"b_y_intensity_ratio": 5, "spectral_angle": 5, "xcorr": 4}
    cols = [
        F.col(c).cast("long").alias(c)
        if c in longs
        else rnd(c, digits=digits.get(c[len(prefix) :], 6))
        for c in [prefix + f for f in N.ION_FEATURES]
    ]
    return out.select("spectrum_id", flag, *cols)


@query(
    "fragment_match",
    f"""WITH {_BUNDLE}, full_row AS (SELECT concat('v:', vec_id) AS spectrum_id, vec_id,
          {_BUNDLE_COLUMNS.format(p='')}
          FROM base JOIN total USING (vec_id) LEFT JOIN series USING (vec_id) LEFT JOIN pairs USING (vec_id)
          LEFT JOIN gap USING (vec_id) JOIN xc USING (vec_id))
        SELECT spectrum_id, vec_id % 8 >= 6 AS is_missing_fragment_match_features, {", ".join(
            f"CASE WHEN vec_id % 8 < 6 THEN {c} ELSE 0 END AS {c}" for c in N.ION_FEATURES)}
        FROM full_row""",
)
def fragment_match(spark, d):
    """Nine ion features; charges 7 and 8 exceed the model and are imputed with zeros."""
    feature = E.FragmentMatch(V.predicted_ions(spark, d), 0.02, "da")
    out = feature(_fragment_rows(spark, d))
    return _fragment_output(out, "", "is_missing_fragment_match_features")


@query(
    "chimeric_match",
    f"""WITH {_BUNDLE} SELECT concat('v:', vec_id) AS spectrum_id, false AS is_missing_chimeric_features,
        {_BUNDLE_COLUMNS.format(p='chimeric_')}
        FROM base JOIN total USING (vec_id) LEFT JOIN series USING (vec_id) LEFT JOIN pairs USING (vec_id)
        LEFT JOIN gap USING (vec_id) JOIN xc USING (vec_id) WHERE vec_id % 8 < 6""",
)
def chimeric_match(spark, d):
    """Runner-up features; unsupported rows are dropped."""
    feature = E.FragmentMatch(
        V.predicted_ions(spark, d), 0.02, "da", learn_from_missing=False, runner_up=True
    )
    out = feature(_fragment_rows(spark, d))
    return _fragment_output(out, "chimeric_", "is_missing_chimeric_features")


@query(
    "ion_array_statistics",
    f"""WITH {_BUNDLE} SELECT concat('v:', vec_id) AS spectrum_id, coalesce(lb, 0) AS longest_b,
        coalesce(ly, 0) AS longest_y, coalesce(pairs.n, 0) AS complementary, round(coalesce(g, 0), 6) AS max_gap,
        round(ratio, 5) AS ratio
        FROM base LEFT JOIN series USING (vec_id) LEFT JOIN pairs USING (vec_id) LEFT JOIN gap USING (vec_id)""",
)
def ion_array_statistics(spark, d):
    """The stateless ion statistics as column expressions over the match lists."""
    ions = E.ions_to_arrays(V.predicted_ions(spark, d))
    rows = V.spectra(spark, d).join(ions, "spectrum_id")
    matched = N.matched_ions(
        F.col("mz"), F.col("annotation"), F.col("mz_array"), F.col("intensity_array"), 0.02, "da"
    )
    m = rows.select("spectrum_id", matched.alias("m")).select("spectrum_id", "m.*")
    a = F.col("annotations")
    return m.select(
        "spectrum_id",
        N.longest_series(a, "b").cast("long").alias("longest_b"),
        N.longest_series(a, "y").cast("long").alias("longest_y"),
        N.complementary_count(a, F.lit(20)).cast("long").alias("complementary"),
        F.round(N.largest_gap(F.col("mz")), 6).alias("max_gap"),
        F.round(N.series_ratio(a, F.col("intensities")), 5).alias("ratio"),
    )


# --- model ------------------------------------------------------------------------------


def _model_rows(spark, d):
    return V.psm(spark, d).select(
        "spectrum_id", "confidence", "correct", F.col("user_id").cast("double").alias("user_id"),
        F.log1p(F.col("retention_time")).alias("log_rt"),
    )


@query("train_predict")
def train_predict(spark, d):
    """Train the ReLU network, score every row, estimate FDR. Rows only: SGD has no SQL."""
    rows = _model_rows(spark, d)
    model = ProbabilityCalibrator(
        ["user_id", "log_rt"], hidden_dims=(16, 8), max_epochs=6, batch_size=128, learning_rate=0.01
    )
    train_rows, val = jobs.random_split(rows, "spectrum_id", 0.1, 42)
    model.fit(train_rows, val, id_column="spectrum_id")
    identity = E.FeatureSet()
    scored = rows.withColumn("valid_prediction", F.lit(True)).withColumn(
        "prediction", F.array(F.lit("A"))
    )
    return jobs.predict(scored, model, identity, threshold=0.5).select(
        "spectrum_id", "calibrated_confidence", "psm_fdr", "psm_q_value", "psm_pep"
    )


@query("train_predict_sigmoid")
def train_predict_sigmoid(spark, d):
    """The JVM-trained sigmoid network on the same rows. Rows only."""
    rows = _model_rows(spark, d)
    model = ProbabilityCalibrator(
        ["user_id", "log_rt"], hidden_dims=(16, 8), max_epochs=10, backend="sigmoid"
    )
    model.fit(rows)
    return model.predict(rows).select("spectrum_id", "calibrated_confidence")


_FIXED_W1 = [[0.1, 0.1, 0.1]] * 4


@query(
    "network_scoring",
    f"""WITH {V.PSM_SQL}, x AS (SELECT spectrum_id, (confidence - 5e-1) / 0.4::double AS a,
          (user_id - 5e1) / 3e1 AS b, (ln(1 + retention_time) - 1e1) / 2e0 AS c FROM psm),
        h AS (SELECT spectrum_id, greatest(0.1::double * (a + b + c) + 0.2::double, 0e0) AS h FROM x)
        SELECT spectrum_id, round(1e0 / (1e0 + exp(-(4 * 0.3::double * h + 0.4::double))), 6)
          AS calibrated_confidence FROM h""",
)
def network_scoring(spark, d):
    """Standardise, 3-4-1 ReLU network with given weights, sigmoid."""
    import numpy as np

    model = ProbabilityCalibrator(["user_id", "log_rt"], hidden_dims=(4,))
    model.mean, model.std = [0.5, 50.0, 10.0], [0.4, 30.0, 2.0]
    model.weights = [
        np.array(_FIXED_W1), np.full(4, 0.2), np.full((1, 4), 0.3), np.array([0.4]),
    ]
    return model.predict(_model_rows(spark, d)).select("spectrum_id", rnd("calibrated_confidence"))


