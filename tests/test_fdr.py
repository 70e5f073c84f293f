import random
import warnings

import pytest
from pyspark.sql import functions as F

from spectrafdr.operators import evaluation, fdr, filters


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_label_free_curve_is_running_mean_error(spark):
    scores = [round(0.9 - 0.1 * i, 1) for i in range(9)]
    df = rows(spark, [(s,) for s in scores], "confidence double")
    curve = fdr.fit_label_free(df, "confidence")
    got = [(r["score"], r["psm_fdr"]) for r in curve.points.orderBy(F.desc("score")).collect()]
    total = 0.0
    for i, s in enumerate(scores):
        total += 1 - s
        assert got[i][0] == s and got[i][1] == pytest.approx(total / (i + 1))


def test_label_based_golden(spark):
    df = rows(
        spark,
        [(0.95, False, True), (0.9, True, True), (0.8, True, True), (0.99, True, False)],
        "confidence double, correct boolean, valid_sequence boolean",
    )
    points = fdr.fit_label_based(df, "confidence", drop=0).points.orderBy(F.desc("score")).collect()
    assert [p["score"] for p in points] == [0.95, 0.9, 0.8]
    assert [p["psm_fdr"] for p in points] == pytest.approx([1.0, 0.5, 1 / 3])


def test_proxy_label_ignores_validity_and_rejects_nulls(spark):
    df = rows(
        spark,
        [(0.9, True, False), (0.8, False, False), (0.7, True, True)],
        "confidence double, proteome_hit boolean, valid_sequence boolean",
    )
    curve = fdr.fit_label_based(df, "confidence", correct="proteome_hit", drop=0)
    assert curve.n_points == 3
    with pytest.raises(ValueError, match="is NULL in some row"):
        fdr.fit_label_based(
            df.withColumn("proteome_hit", F.when(F.col("confidence") > 0.8, True)),
            "confidence", correct="proteome_hit", drop=0,
        )
    with pytest.raises(ValueError, match="boolean or number"):
        fdr.fit_label_based(
            df.withColumn("proteome_hit", F.lit("yes")), "confidence", correct="proteome_hit"
        )


def test_errors(spark):
    empty = rows(spark, [], "confidence double")
    with pytest.raises(ValueError, match="no row has a score"):
        fdr.fit_label_free(empty, "confidence")
    few = rows(spark, [(0.5, True)], "confidence double, hit boolean")
    with pytest.raises(ValueError, match="first 10 positions are dropped"):
        fdr.fit_label_based(few, "confidence", correct="hit")
    with pytest.raises(ValueError, match="missing column"):
        fdr.fit_label_based(few, "confidence", correct="absent")


def test_cutoff_edges(spark):
    df = rows(spark, [(0.9,), (0.8,), (0.5,)], "s double")
    curve = fdr.fit_label_free(df, "s")
    with pytest.warns(UserWarning, match="no score qualifies"):
        assert fdr.confidence_cutoff(curve, 0.01) is None
    with pytest.warns(UserWarning, match="above the fitted range"):
        assert fdr.confidence_cutoff(curve, 0.99) == 0.5
    assert fdr.confidence_cutoff(curve, 0.15) == 0.8
    assert fdr.filter_above(df, "s", 0.8).count() == 1
    assert fdr.filter_at(df, "s", 0.8).count() == 2
    assert fdr.filter_at(df, "s", None).count() == 0
    assert fdr.filter_at(df, "s", None, keep_all_without_cutoff=True).count() == 3
    assert fdr.filter_above(df, "s", None).count() == 0


def test_confidence_curve_is_non_increasing(spark):
    df = rows(spark, [(i / 100,) for i in range(1, 100)], "s double")
    curve = fdr.fit_label_free(df, "s")
    grid = fdr.confidence_curve(curve, 0.01, 0.01, 0.11).orderBy("threshold").collect()
    assert len(grid) == 10
    cutoffs = [r["cutoff"] for r in grid if r["cutoff"] is not None]
    assert cutoffs == sorted(cutoffs, reverse=True)


def test_lookup_outside_the_fitted_range(spark):
    curve = fdr.fit_label_free(rows(spark, [(0.9,), (0.5,)], "s double"), "s")
    out = fdr.annotate(rows(spark, [(0.95,), (0.7,), (0.2,), (None,)], "s double"), "s", curve)
    got = {r["s"]: r["psm_fdr"] for r in out.collect()}
    assert got[0.95] == pytest.approx(0.1)
    assert got[0.7] == pytest.approx(0.3)
    assert got[0.2] == 1.0
    assert got[None] is None


def brute(scores, hits, drop):
    """Row-level reference: incorrect first inside a tie."""
    order = sorted(zip(scores, hits), key=lambda x: (-x[0], x[1]))
    curve, good = [], 0
    for i, (s, y) in enumerate(order):
        good += y
        if i >= drop:
            curve.append((s, 1 - good / (i + 1)))
    return curve


@pytest.mark.parametrize("seed", [0, 1])
def test_scaled_paths_equal_row_level_brute_force(spark, tiny_limits, seed):
    """Many buckets, salted hot score (a third of the rows), shuffled look-up."""
    rng = random.Random(seed)
    scores = [rng.choice([0.5] * 30 + [i / 60 for i in range(60)]) for _ in range(240)]
    hits = [int(rng.random() < s) for s in scores]
    df = rows(
        spark, [(i, s, bool(y)) for i, (s, y) in enumerate(zip(scores, hits))],
        "id int, s double, hit boolean",
    )
    # label free
    curve = fdr.fit_label_free(df, "s")
    run, expect = 0.0, {}
    for i, s in enumerate(sorted(scores, reverse=True)):
        run += 1 - s
        expect.setdefault(s, run / (i + 1))
    out = fdr.annotate(df, "s", curve, same_scores=True, salt_on=["id"]).collect()
    assert len(out) == 240
    for r in out:
        assert r["psm_fdr"] == pytest.approx(expect[r["s"]])
        assert r["psm_q_value"] == pytest.approx(expect[r["s"]])
    # label based, with dropped positions and as-of look-up
    line = brute(scores, hits, 10)
    curve = fdr.fit_label_based(df, "s", correct="hit", drop=10)
    firsts: dict = {}
    for s, v in line:
        firsts.setdefault(s, v)
    lows = {s: min(v for t, v in line if t == s) for s in firsts}
    got = {r["score"]: (r["psm_fdr"], r["low_fdr"]) for r in curve.points.collect()}
    assert got.keys() == firsts.keys()
    for s in firsts:
        assert got[s] == (pytest.approx(firsts[s]), pytest.approx(lows[s]))
    looked = {}
    for s in set(scores):
        below = [t for t in firsts if t <= s]
        looked[s] = firsts[max(below)] if below else 1.0
    q = {s: min(looked[t] for t in looked if t <= s) for s in looked}
    for r in fdr.annotate(df, "s", curve, salt_on=["id"]).collect():
        assert r["psm_fdr"] == pytest.approx(looked[r["s"]])
        assert r["psm_q_value"] == pytest.approx(q[r["s"]])
    for t in (0.2, 0.4, 0.6):
        best = [s for s, v in line if v <= t]
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            assert fdr.confidence_cutoff(curve, t) == (min(best) if best else None)


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(3000).selectExpr("id", "((id * 37) % 101) / 101e0 AS s")
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            part = df.repartition(int(n))
            out = fdr.annotate(part, "s", fdr.fit_label_free(part, "s"), same_scores=True)
            row = out.agg(
                F.sum(F.round("psm_fdr", 9)).alias("f"), F.count("*").alias("n")
            ).first()
            seen.add((round(row["f"], 6), row["n"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_q_value_invariants(spark):
    df = spark.range(500).selectExpr("id", "((id * 91) % 77) / 77e0 AS s", "id % 3 > 0 AS hit")
    curve = fdr.fit_label_based(df, "s", correct="hit", drop=10)
    out = fdr.annotate(df, "s", curve).orderBy("s").collect()
    assert all(r["psm_q_value"] <= r["psm_fdr"] + 1e-12 for r in out)
    q = [r["psm_q_value"] for r in out]
    assert q == sorted(q, reverse=True)


def test_precision_recall_and_frequency_bins_scaled(spark, tiny_limits):
    data = [(i, (i * 13 % 17) / 17, i % 4 > 0) for i in range(100)]
    df = rows(spark, data, "id int, s double, y boolean")
    order = sorted(data, key=lambda r: (-r[1], r[0]))
    hits, expect = 0, {}
    for i, (id_, _, y) in enumerate(order):
        hits += y
        expect[id_] = (i + 1, hits / (i + 1), hits / 100)
    for r in evaluation.precision_recall(df, "s", "y", "id").collect():
        rank, precision, recall = expect[r["id"]]
        assert r["rank"] == rank
        assert r["precision"] == pytest.approx(precision)
        assert r["recall"] == pytest.approx(recall)
    ascending = sorted(data, key=lambda r: (r[1], r[2]))
    for n_bins in (7, 40, 130):
        edges = [k * 100 // n_bins for k in range(n_bins + 1)]
        want = {
            k: (
                sum(r[1] for r in ascending[a:b]) / (b - a),
                sum(r[2] for r in ascending[a:b]) / (b - a),
                b - a,
            )
            for k, (a, b) in enumerate(zip(edges, edges[1:]))
            if b > a
        }
        got = {
            r["bin"]: (r["mean_score"], r["empirical_rate"], r["weight"])
            for r in evaluation.calibration_curve_frequency(df, "s", "y", n_bins).collect()
        }
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k])


def test_label_coercion(spark):
    df = rows(spark, [(1.0,), (0.0,)], "y double")
    assert [r[0] for r in filters.boolean_labels(df, "y").collect()] == [True, False]
    with pytest.raises(Exception, match="is NULL in some row"):
        filters.boolean_labels(rows(spark, [(None,), (1.0,)], "y double"), "y").collect()


def test_custom_method_supplies_its_own_points(spark):
    golden = [(0.9, 0.01), (0.8, 0.02), (0.7, 0.05), (0.6, 0.1), (0.5, 0.2)]
    points = rows(spark, [(s, 1, v, v) for s, v in golden], "score double, n bigint, psm_fdr double, low_fdr double")
    curve = fdr.curve_from_points(points, 5)
    out = fdr.annotate(rows(spark, [(s,) for s, _ in golden], "s double"), "s", curve)
    assert {r["s"]: r["psm_q_value"] for r in out.collect()} == dict(golden)
    assert fdr.confidence_cutoff(curve, 0.05) == 0.7
