import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafdr.constants import BEAM_TYPE, CARBON_ISOTOPE_MASS_SHIFT, RESIDUE_MASSES
from spectrafdr.functions import peptides as P
from spectrafdr.functions import spectra as N
from spectrafdr.operators import features as E
from spectrafdr.operators import filters

# --- peptides -----------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("GAIT(+0.98)SVK[UNIMOD:21]R", "GALTSVKR"),
        ("[UNIMOD:737]-LIVE[UNIMOD:4](+57.02)WD", "LLVEWD"),
        ("(-17.03)-QAHLK", "QAHLK"),
        ("MAIL+15.995FN", "MALLFN"),
        ("MAIL-18.01FN", "MALLFN"),
        ("MAIL79.97FN", "MALLFN"),
        ("-17.03-QAHLK", "QAHLK"),
        (None, ""),
    ],
)
def test_stripped_for_match(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(P.stripped_for_match(F.col("raw"))).first()[0] == expected


@pytest.mark.parametrize(
    "tokens, expected",
    [
        (["[UNIMOD:1]", *"PEPTIDE", "[UNIMOD:2]"], "[UNIMOD:1]-PEPTIDE-[UNIMOD:2]"),
        (["[UNIMOD:1]", *"PEPTIDE"], "[UNIMOD:1]-PEPTIDE"),
        ([*"PEPTIDE", "[UNIMOD:2]"], "PEPTIDE-[UNIMOD:2]"),
        (["M[UNIMOD:35]", *"PEPTIDE"], "M[UNIMOD:35]PEPTIDE"),
        (["[UNIMOD:1]"], "[UNIMOD:1]"),
        (["(+1)", "[x]"], "(+1)-[x]"),
        ([], ""),
        (None, ""),
    ],
)
def test_proforma(spark, tokens, expected):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(P.proforma(F.col("t"))).first()[0] == expected


def test_tokenise_and_normalise(spark):
    text = "[UNIMOD:1]-PEPM[UNIMOD:35]C(+57.02)+42.011K"
    df = spark.createDataFrame([(text, "[Acetyl]LM(ox)", " ")], "a string, b string, c string")
    row = df.select(
        P.tokenise(F.col("a")).alias("a"),
        P.normalise_peptide(F.col("b"), False, {"M(ox)": "M[UNIMOD:35]"}).alias("b"),
        P.normalise_peptide(F.col("c"), False).alias("c"),
    ).first()
    assert row["a"] == ["[UNIMOD:1]", "P", "E", "P", "M[UNIMOD:35]", "C(+57.02)", "+42.011", "K"]
    assert row["b"] == ["[Acetyl]", "I", "M[UNIMOD:35]"]
    assert row["c"] is None


def test_residue_count(spark):
    df = spark.createDataFrame([("PEPTIDE",), ("PEP(+123.45)TIDE",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(P.residue_count(F.col("s"), False)).collect()] == [7, 7, 0, 0]


def brute_matches(a, b):
    ma, mb = [RESIDUE_MASSES[x] for x in a], [RESIDUE_MASSES[x] for x in b]
    ca, cb = np.cumsum(ma), np.cumsum(mb)
    i = j = n = 0
    while i < len(a) and j < len(b):
        if abs(ca[i] - cb[j]) < 0.5:
            n += abs(ma[i] - mb[j]) < 0.1
            i, j = i + 1, j + 1
        elif ca[i] < cb[j]:
            i += 1
        else:
            j += 1
    return n


def test_residue_matches(spark):
    rng = np.random.default_rng(0)
    letters = list("GASPVTCLINDQKEMHFRYW") + ["M[UNIMOD:35]", "[UNIMOD:1]"]
    pairs = [(["A", "G"], ["A", "G"]), (["G", "G", "A"], ["N", "A"]), ([], ["A"]), (None, ["A"])]
    for _ in range(40):
        a = list(rng.choice(letters, rng.integers(1, 12)))
        b = list(a)
        rng.shuffle(b)
        pairs.append(([str(x) for x in a], [str(x) for x in b]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                               "i int, a array<string>, b array<string>")
    got = df.select("i", P.residue_matches(F.col("a"), F.col("b"))).orderBy("i").collect()
    for (_, n), (a, b) in zip(got, pairs):
        assert n == (brute_matches(a, b) if a and b else 0)


@pytest.mark.parametrize(
    "a, b, expected",
    [("A", "G", 1.0), ("LAG", "IAG", 0.0), ("LAK", "IGK", 1 / 3), ("LAM", "IGM", 1 / 3)],
)
def test_edit_distance(spark, a, b, expected):
    df = spark.createDataFrame([(list(a), list(b))], "a array<string>, b array<string>")
    out = df.select(
        P.token_edit_distance(
            P.leucine_to_isoleucine(F.col("a")), P.leucine_to_isoleucine(F.col("b"))
        )
    )
    assert out.first()[0] == pytest.approx(expected)


def test_misplaced_modification(spark):
    texts = ["[+42.011]PEP", "PEP[+42.011]", "[+42.011]P[+42.011]", "PEP", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(P.misplaced_terminal_mod(F.col("s"), ("[+42.011]",))).collect()]
    assert got == [False, True, True, False, False]


# --- column features -------------------------------------------------------------


def beam_frame(spark, *beams):
    rows = [
        (i, None if b is None else [(s, math.log(p), t) for s, p, t in b])
        for i, b in enumerate(beams)
    ]
    return spark.createDataFrame(rows, "i int, b " + BEAM_TYPE.simpleString()).withColumnRenamed(
        "b", "beams"
    )


def test_beam_statistics_golden(spark):
    third = 1 / 3
    df = beam_frame(
        spark,
        [(["A"], 0.7, None), (["G"], 0.2, None), (["S"], 0.1, None)],
        [(["A"], third, None)] * 3,
        [(["A"], 0.6, None)],
        None,
    )
    a, b, c, e = E.BeamStatistics()(df).orderBy("i").collect()
    assert a["margin"] == pytest.approx(0.5)
    assert a["median_margin"] == pytest.approx(0.55)
    assert a["entropy"] == pytest.approx(0.6365141682948128)
    assert a["z-score"] == pytest.approx(1.3970013970020956)
    assert a["edit_distance"] == 1.0
    assert b["margin"] == 0 and b["median_margin"] == 0
    assert b["entropy"] == pytest.approx(math.log(2)) and b["edit_distance"] == 0.0
    assert c["margin"] == pytest.approx(0.6) and c["entropy"] == 0 and c["z-score"] == 0
    assert c["edit_distance"] == 1.0
    assert (e["margin"], e["entropy"], e["z-score"], e["edit_distance"]) == (0, 0, 0, 1.0)


def test_token_scores_golden(spark):
    lists = [[0.9, 0.8, 0.7], [0.95, 0.85], [0.6, 0.7, 0.8, 0.9], [0.5]]
    df = beam_frame(spark, *[[(["A"], 0.9, [math.log(x) for x in v])] for v in lists])
    for row, v in zip(E.TokenScores()(df).orderBy("i").collect(), lists):
        assert row["min_token_probability"] == pytest.approx(min(v))
        assert row["std_token_probability"] == pytest.approx(np.std(v) if len(v) > 1 else 0.0)
    with pytest.raises(Exception, match="token_log_probs"):
        E.TokenScores()(beam_frame(spark, [(["A"], 0.9, None)])).collect()


def test_mass_error(spark):
    tokens, z = ["A", "G", "K"], 2
    theory = (sum(RESIDUE_MASSES[t] for t in tokens) + 18.0106 + z * 1.007276) / z
    shifted = theory + CARBON_ISOTOPE_MASS_SHIFT / z
    df = spark.createDataFrame(
        [(0, tokens, theory, z), (1, tokens, shifted, z), (2, tokens, theory * (1 + 5e-6), z)],
        "i int, prediction array<string>, precursor_mz double, precursor_charge int",
    )
    out = E.MassError("da")(E.MassError("ppm")(df)).orderBy("i").collect()
    assert out[0]["mass_error_ppm"] == pytest.approx(0, abs=1e-6)
    assert out[1]["mass_error_ppm"] == pytest.approx(0, abs=1e-6)
    assert out[2]["mass_error_ppm"] == pytest.approx(-5, rel=1e-3)
    assert out[2]["mass_error_da"] == pytest.approx(-theory * 5e-6 * z, rel=1e-3)
    no_isotope = E.MassError("da", isotope_range=(0, 0))(df).orderBy("i").collect()
    assert no_isotope[1]["mass_error_da"] == pytest.approx(-CARBON_ISOTOPE_MASS_SHIFT, rel=1e-6)
    with pytest.raises(Exception, match="non-empty token list"):
        E.MassError()(df.withColumn("prediction", F.lit(None).cast("array<string>"))).collect()
    with pytest.raises(Exception, match="unknown residue"):
        E.MassError()(df.withColumn("prediction", F.array(F.lit("?")))).collect()


# --- spectra -----------------------------------------------------------------------

B = lambda n: [f"b{i + 1}+1" for i in range(n)]


@pytest.mark.parametrize(
    "ions, peaks, heights, tol, unit, rate, share",
    [
        ([100, 200, 300], [100, 200, 400], [1000, 2000, 4000], 0.01, "da", 2 / 3, 3 / 7),
        ([100, 200], [100.005, 200.01], [1000, 2000], 0.02, "da", 1, 1),
        ([100, 100.005], [100.002], [1000], 0.02, "da", 1 / 2, 1),
        ([100, 100.01], [100.002, 100.015], [1, 1], 0.02, "da", 1, 1),
        ([100, 101], [100, 101.003, 150], [1000, 500, 2000], 0.02, "da", 1 / 2, 1500 / 3500),
        ([500, 1000], [500.009, 1000.019], [1, 1], 20, "ppm", 1, 1),
        ([100], [100.015], [1], 20, "ppm", 0, 0),
        ([1000], [1000.015], [1], 20, "ppm", 1, 1),
        ([100], [100.02], [1], 0.02, "da", 0, 0),
        ([], [100.0], [1], 0.02, "da", 0, 0),
        ([100], [], [], 0.02, "da", 0, 0),
    ],
)
def test_peak_matching_golden(spark, ions, peaks, heights, tol, unit, rate, share):
    f = lambda xs: [float(x) for x in xs]
    df = spark.createDataFrame(
        [(f(ions), B(len(ions)), f(peaks), f(heights))],
        "m array<double>, a array<string>, p array<double>, h array<double>",
    )
    m = df.select(
        N.matched_ions(F.col("m"), F.col("a"), F.col("p"), F.col("h"), tol, unit).alias("x")
    ).first()["x"]
    if 100.02 in peaks:  # on the edge up to rounding: only strictly closer peaks match
        assert m["match_rate"] == float(abs(100.02 - 100.0) < 0.02)
        return
    assert m["match_rate"] == pytest.approx(rate)
    assert m["match_intensity"] == pytest.approx(share)
    assert len(m["aligned"]) == len(ions)


def slow_match(ions, charges, peaks, heights, tol):
    """Nearest free peak by plain search, for comparison."""
    used, own, env = set(), [], []

    def take(q):
        options = sorted(
            (abs(p - q), p >= q, j if p >= q else -j, j)
            for j, p in enumerate(peaks) if j not in used and abs(p - q) < tol
        )
        if not options:
            return None
        used.add(options[0][3])
        return options[0][3]

    for q, z in zip(ions, charges):
        j = take(q)
        if j is None:
            own.append(0.0)
            env.append(0.0)
            continue
        own.append(heights[j])
        total = heights[j]
        for k in range(1, 5):
            i = take(q + k * CARBON_ISOTOPE_MASS_SHIFT / z)
            total += heights[i] if i is not None else 0.0
        env.append(total)
    return own, env


def test_peak_matching_equals_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(60):
        peaks = np.sort(rng.choice(np.arange(100, 130, 0.25), rng.integers(5, 60)))
        ions = np.sort(rng.choice(np.arange(100, 130, 0.125), rng.integers(1, 20)))
        heights = rng.random(len(peaks))
        charges = rng.integers(1, 3, len(ions)).astype(float)
        _, own, env = N.match_peaks(ions, charges, peaks, heights, 0.6, "da")
        slow_own, slow_env = slow_match(ions, charges, peaks, heights, 0.6)
        assert own.tolist() == pytest.approx(slow_own)
        assert env.tolist() == pytest.approx(slow_env)


def test_ion_statistics_golden(spark):
    df = spark.createDataFrame(
        [(
            ["b1+1", "b2+1", "b3+1", "y1+1", "b5+1", "b6+1"], ["b1", "b1", "b2", "b2", "b3"],
            ["b1+1", "y3+1", "b2+1"], ["b1+1", "y4+1", "b2+1", "y3+1"], [300.0, 100.0, 150.0],
            ["b1+1", "b2+1", "y1+1", "y2+1"], [1000.0, 2000.0, 500.0, 500.0], [],
        )],
        "a array<string>, c array<string>, p array<string>, q array<string>, m array<double>, "
        "n array<string>, i array<double>, e array<string>",
    )
    row = df.select(
        N.longest_series(F.col("a"), "b"), N.longest_series(F.col("a"), "y"),
        N.longest_series(F.col("c"), "b"), N.longest_series(F.col("e"), "b"),
        N.complementary_count(F.col("p"), F.lit(4)), N.complementary_count(F.col("q"), F.lit(5)),
        N.largest_gap(F.col("m")), N.series_ratio(F.col("n"), F.col("i")),
    ).first()
    assert list(row)[:7] == [3, 1, 3, 0, 1, 2, 150.0]
    assert row[7] == pytest.approx(3.0)


@pytest.mark.parametrize(
    "a, b, expected",
    [([1, 2, 3], [2, 4, 6], 1.0), ([1, 0], [0, 1], 0.0), ([], [], 0.0), ([0, 0], [1, 1], 0.0),
     (None, [1.0], 0.0)],
)
def test_spectral_angle_golden(spark, a, b, expected):
    f = lambda xs: None if xs is None else [float(x) for x in xs]
    df = spark.createDataFrame([(f(a), f(b))], "a array<double>, b array<double>")
    assert df.select(N.spectral_angle(F.col("a"), F.col("b"))).first()[0] == pytest.approx(
        expected, abs=1e-7
    )
    if a is not None:
        assert N.angle_similarity(np.array(f(a)), np.array(f(b))) == pytest.approx(expected, abs=1e-7)


def test_xcorr_edges():
    peaks, heights = np.array([100.0, 200.0, 300.0]), np.array([1.0, 4.0, 9.0])
    none = np.empty(0)
    assert N.xcorr_score(none, none, peaks) == 0.0
    assert N.xcorr_score(peaks, heights, none) == 0.0
    assert N.xcorr_score(np.array([5.0]), np.array([1.0]), np.array([5.0])) == 0.0
    aligned = N.xcorr_score(peaks, heights, peaks)
    assert aligned > N.xcorr_score(peaks, heights, np.array([150.0, 250.0]))
    assert aligned == pytest.approx(N.xcorr_score(peaks, heights * 100, peaks))


def spectrum_rows(spark):
    schema = (
        "spectrum_id string, precursor_charge int, prediction array<string>, mz_array array<double>,"
        " intensity_array array<double>"
    )
    return spark.createDataFrame(
        [
            ("s1", 2, list("AGK"), [100.0, 200.0, 300.0], [1000.0, 2000.0, 3000.0]),
            ("s2", 9, list("AGK"), [100.0, 200.0], [1.0, 1.0]),
            ("s3", 2, list("AGK"), [50.0], [1.0]),
        ],
        schema,
    )


def ion_rows(spark):
    from spectrafdr.constants import PREDICTED_ION_SCHEMA

    rows = [
        (s, "AGK", 2, 27, i, m, a)
        for s in ("s1", "s2")
        for i, m, a in ((0.5, 200.0, "y2+1"), (1.0, 100.0, "b1+1"))
    ]
    return spark.createDataFrame(rows, PREDICTED_ION_SCHEMA)


def test_fragment_match_policies(spark):
    feature = E.FragmentMatch(ion_rows(spark), 0.02, "da")
    out = {r["spectrum_id"]: r for r in feature(spectrum_rows(spark)).collect()}
    assert len(out) == 3
    one = out["s1"]
    assert one["ion_matches"] == 1.0 and one["ion_match_intensity"] == pytest.approx(0.5)
    assert one["theoretical_mz"] == [100.0, 200.0] and one["complementary_ion_count"] == 1
    assert one["max_ion_gap"] == 100.0 and not one["is_missing_fragment_match_features"]
    assert out["s2"]["is_missing_fragment_match_features"] and out["s2"]["ion_matches"] == 0.0
    assert out["s3"]["xcorr"] == 0.0  # valid, but no predicted spectrum
    strict = E.FragmentMatch(ion_rows(spark), 0.02, "da", learn_from_missing=False)
    assert strict(spectrum_rows(spark)).count() == 2
    assert "is_missing_fragment_match_features" not in strict.columns
    with pytest.raises(ValueError, match="unknown unit"):
        E.FragmentMatch(ion_rows(spark), 0.02, "amu")


def test_model_support(spark):
    df = spark.createDataFrame(
        [(["A"] * 3, 2), (["A"] * 31, 2), (["A", "[UNIMOD:5]"], 2), (None, 2), (["A"], 7)],
        "t array<string>, z int",
    )
    got = df.select(filters.model_supports(F.col("t"), 30, ["[UNIMOD:5]"], F.col("z"), 6)).collect()
    assert [r[0] for r in got] == [True, False, False, False, False]


def test_model_inputs(spark):
    df = spark.createDataFrame([(1, 30.0)], "x int, nce double")
    out = E.model_inputs(df, ["p", "e", "f"], ["p"], {"f": "HCD"}, {"e": "nce"}).first()
    assert (out["e"], out["f"]) == (30.0, "HCD")
    with pytest.raises(ValueError, match="both"):
        E.model_inputs(df, ["e"], [], {"e": 1}, {"e": "nce"})
    with pytest.raises(ValueError, match="without a value"):
        E.model_inputs(df, ["e"], [])
    with pytest.raises(ValueError, match="not found"):
        E.model_inputs(df, ["e"], [], None, {"e": "absent"})


# --- retention time ---------------------------------------------------------------------


def rt_rows(spark, n=40, experiments=("a",)):
    rows = []
    for x in experiments:
        for i in range(n):
            rows.append((f"{x}:{i}", x, ["A"] * (1 + i % 5) + ["K"], 1 - i / 100, float(i * 10)))
    return spark.createDataFrame(
        rows,
        "spectrum_id string, experiment_name string, prediction array<string>, confidence double, "
        "retention_time double",
    )


def irt_table(spark):
    return spark.createDataFrame([("A" * k + "K", 10.0 * k) for k in range(1, 6)], "peptide string, irt double")


def test_retention_time_error(spark):
    feature = E.RetentionTime(irt_table(spark), train_fraction=0.5, min_train_points=5)
    out = feature(rt_rows(spark)).orderBy("retention_time").toPandas()
    x = np.array([i * 10.0 for i in range(20)])
    y = np.array([10.0 * (1 + i % 5) for i in range(20)])
    slope, intercept = np.polyfit(x, y, 1)
    want = np.abs(slope * out["retention_time"] + intercept - out["iRT"])
    assert np.allclose(out["irt_error"], want)
    assert not out["is_missing_irt_error"].any()


def test_retention_time_skips_poor_experiments(spark):
    df = rt_rows(spark, experiments=("a", "b"))
    lone = df.withColumn(
        "prediction",
        F.when(F.col("experiment_name") == "b", F.array(F.lit("A"), F.lit("K"))).otherwise(
            F.col("prediction")
        ),
    )
    feature = E.RetentionTime(irt_table(spark), train_fraction=0.5, min_train_points=5)
    out = feature(lone)
    assert out.filter("experiment_name = 'b' AND is_missing_irt_error").count() == 40
    assert out.filter("experiment_name = 'b'").agg(F.max("irt_error")).first()[0] == 0.0
    status = {r["experiment_name"]: r["status"] for r in feature.fitted.collect()}
    assert status["b"] == "too few distinct peptides" and status["a"].startswith("ok")
    dropping = E.RetentionTime(
        irt_table(spark), train_fraction=0.5, min_train_points=5, learn_from_missing=False
    )
    assert dropping(lone).count() == 40
    small = E.RetentionTime(irt_table(spark), train_fraction=0.1, min_train_points=10)
    assert small.fit(df).filter("status = 'too few training points'").count() == 2


def test_retention_time_global_and_pinned(spark):
    rows = rt_rows(spark)
    one = E.RetentionTime(irt_table(spark), train_fraction=0.5)
    assert [r[0] for r in one.fit(rows.drop("experiment_name")).select("experiment_name").collect()] == [
        E.GLOBAL_EXPERIMENT
    ]
    pinned = spark.createDataFrame([("a", 0.0, 7.0)], "experiment_name string, slope double, intercept double")
    feature = E.RetentionTime(irt_table(spark), regressors=pinned)
    out = feature(rows).select("predicted iRT").distinct().collect()
    assert [r[0] for r in out] == [7.0]


@pytest.mark.parametrize("fraction", [0.1, 0.25, 1.0])
def test_top_fraction_scaled(spark, tiny_limits, fraction):
    """One group holds most rows and one score most of its rows."""
    data = [(i, "hot" if i % 5 else f"g{i % 3}", 0.5 if i % 3 else (i % 11) / 11) for i in range(150)]
    df = spark.createDataFrame(data, "id int, g string, s double")
    want = set()
    for g in {r[1] for r in data}:
        rows = sorted((r for r in data if r[1] == g), key=lambda r: (-r[2], r[0]))
        want |= {r[0] for r in rows[: max(1, int(fraction * len(rows)))]}
    got = [r["id"] for r in E.top_fraction(df, "g", "s", "id", fraction).collect()]
    assert len(got) == len(want) and set(got) == want


# --- registry ------------------------------------------------------------------------------


class _Needs:
    def __init__(self, name, dependencies):
        self.name, self.columns, self.dependencies = name, [name], dependencies

    def __call__(self, df):
        return df.withColumn(self.name, F.col("shared") + 1)


def test_feature_set(spark):
    shared = E.CustomFeature("shared", ["shared"], lambda df: df.withColumn("shared", F.lit(1)))
    chosen = E.FeatureSet(_Needs("x", [shared]), _Needs("y", [shared]))
    row = chosen(spark.range(1)).first()
    assert (row["x"], row["y"]) == (2, 2) and chosen.columns == ["x", "y"]
    with pytest.raises(KeyError):
        chosen.add(_Needs("x", []))
    chosen.remove("x")
    assert chosen.dependency_names == ["shared"]
    chosen.remove("y")
    assert chosen.dependency_names == [] and chosen.names == []


def test_missing_counts(spark):
    df = beam_frame(spark, [(["A"], 0.5, None)] * 2, None).withColumn(
        "is_missing_x", F.col("i") == 0
    )
    row = E.missing_counts(df).first()
    assert (row["n_rows"], row["n_short_beams"], row["n_is_missing_x"]) == (2, 1, 1)
