"""Hard negatives against all pairs, with tiny groups, awkward rows and bounds that hold."""

import fixtures as fx
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafdr.llm import hard_negatives

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def brute(rows, positives=5, negatives=3, every=50, low=50, high=95):
    usable = [
        (i, [int(np.floor(256 * float(x))) for x in v], la)
        for i, v, la in rows
        if i is not None and la is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    anchors = {}
    for i, v, la in usable:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (v, la)), (v, la))
    out = []
    for i, (q, la) in anchors.items():
        scored = [(-sum(a * b for a, b in zip(q, v, strict=False)), j, other) for j, v, other in usable if j != i]
        best = sorted(s[:2] for s in scored if s[2] == la)[:positives]
        for score, p in best:
            inside = sorted(s[:2] for s in scored if s[2] != la and low * -score <= 100 * -s[0] <= high * -score)
            out += [(i, p, r, n, -score, -s) for r, (s, n) in enumerate(inside[:negatives], start=1)]
    return sorted(out)


def random_rows(n, seed, clusters=8, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    of = rng.integers(0, clusters, n)
    points = centres[of] + 0.3 * rng.normal(size=(n, width))
    return [(int(i), [float(np.float32(x)) for x in p], int(c % 3)) for i, (p, c) in enumerate(zip(points, of, strict=True))]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def mined(df, every=50, **options):
    found = hard_negatives.mine(df, F.col("vec_id") % every == 0, **options)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("held, asked", [(512, 16_384), (7, 3)])
def test_matches_all_pairs_also_in_tiny_groups(spark, monkeypatch, held, asked):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS_PER_GROUP", held)
    monkeypatch.setattr(hard_negatives, "ROWS_PER_GROUP", held)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_GROUP", asked)
    rows = random_rows(300, 3)
    rows += [(900 + i, rows[100][1], 1) for i in range(40)]  # ties: equal vectors, other ids
    rows += [rows[5]] * 9  # repeated rows
    assert mined(table(spark, rows), every=10) == brute(rows, every=10)


def test_rows_without_part_in_it(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(60, 7, width=3)
    rows += [
        (None, [1.0, 2.0, 3.0], 0), (100, None, 0), (150, [1.0, None, 2.0], 1), (200, [nan, 0.0, 1.0], 1), (250, [inf, 0.0, 1.0], 2),
        (300, [0.0, 0.0, 0.0], 1), (350, [1.0, 1.0, 1.0], None), (400, [], 1), (450, [2.0], 0), (50, [9.0, 1.0, 1.0], 2),
    ]
    assert mined(table(spark, rows)) == brute(rows)


def test_empty_single_and_zero_tables(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(0, [1.0, 2.0], 1)])) == []
    zeros = [(i, [0.0, 0.0], i % 2) for i in range(6)]
    assert mined(table(spark, zeros)) == brute(zeros)


def test_clashing_columns_change_nothing(spark):
    rows = random_rows(120, 11)
    plain = table(spark, rows)
    clashing = plain.withColumns(
        {n: F.lit("clash") for n in (*fx.CLASHING, "row", "vector", "norm", "angles", "region", "salt", "part", "is_anchor")
         if n not in plain.columns}
    )
    assert mined(clashing) == mined(plain) == brute(rows)


def test_intervals_hold_every_score_and_prune_clusters():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 1000
    points = np.floor(np.repeat(centres, 60, axis=0) + rng.normal(size=(1200, 16)) * 20).astype(np.int64)
    points[:3] = 0
    references = hard_negatives.farthest_first(points.astype(float), 16)
    norms, angles = hard_negatives.angles_of(points, references)
    lower, upper = hard_negatives.score_bounds(angles, norms, angles, angles, norms, norms)
    scores = points @ points.T
    assert (lower <= scores).all() and (scores <= upper).all()
    boxes = hard_negatives.Candidates(np.arange(1200), np.zeros(1200, int), points, norms, angles)
    low, high = hard_negatives.score_bounds(angles, norms, boxes.least, boxes.most, boxes.short, boxes.long)
    ordered = points @ boxes.points.T
    for cell, start in enumerate(boxes.starts):
        own = ordered[:, start : start + hard_negatives.CELL]
        assert (low[:, cell, None] <= own).all() and (own <= high[:, cell, None]).all()
    best = hard_negatives.Best(np.full((1200, 1), -(1 << 60)), np.full((1200, 1), 1 << 60), 5)
    assert hard_negatives.search(boxes, boxes, best, same_label=True) < 1200 * 1200 / 2


def test_large_components_stay_integers(spark):
    rows = [(i, [float(1 << 22) + i, float(i)], i % 2) for i in range(60)]
    assert mined(table(spark, rows), low=0, high=100) == brute(rows, low=0, high=100)
