"""Medians and descents on keys of all sizes, with ties, nulls and one key that has most rows."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.operators import alignment, scale


def values():
    rng = random.Random(6)
    out = {0: [1.0], 1: [1.0, 2.0], 2: [5.0] * 300, 3: [1.0] * 150 + [2.0] * 150, 4: [rng.gauss(0, 1) for _ in range(501)], 5: [rng.lognormvariate(0, 8) for _ in range(700)]}
    return out | {6: [-1e308, 1e308, 0.0] * 40, 7: [rng.choice([1.0, 2.0, 3.0]) for _ in range(333)], 8: [-math.inf, 1.0, 2.0, 3.0, math.inf]}


@pytest.mark.parametrize("few", [1, 20, 4096])
def test_medians(spark, few):
    own = {k: v for k, v in values().items() if k < 8 or few == 4096}
    rows = [(k, v) for k, vs in own.items() for v in vs] + [(0, None), (0, math.nan), (9, None)]
    random.Random(0).shuffle(rows)
    got = {r.k: (r.median, r.n) for r in scale.medians(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", few).collect()}
    assert got == {k: (statistics.median(v), len(v)) for k, v in own.items()}


def pairs(spark):
    rng = random.Random(3)
    rows = []
    for key, n in ((0, 2000), (1, 40), (2, 5), (3, 1)):
        for _ in range(n):
            bottom = rng.uniform(0.5, 3)
            rows.append((key, bottom * (1.5 + key) + rng.gauss(0, 0.05) + (rng.random() < 0.2) * rng.uniform(2, 6), bottom))
    return spark.createDataFrame([*rows, (0, None, 1.0), (1, 1.0, None), (2, math.nan, 1.0), (None, 1.0, 1.0)], "k int, top double, bottom double")


def test_descent_agrees_with_reweighting(spark):
    df = pairs(spark).where("top is not null and bottom is not null and not isnan(top) and k is not null")
    want = {r.k: r.scale for r in alignment.robust_scale(df, ["k"], F.col("top"), F.col("bottom"), F.lit(2.0), sigma=0.5, rounds=60).collect()}
    got = {r.k: (r.scale, r.n) for r in scale.descended(pairs(spark), ["k"], F.col("top"), F.col("bottom"), F.lit(2.0)).collect()}
    assert set(got) == set(want) and [got[k][1] for k in range(4)] == [2000, 40, 5, 1]
    assert all(abs(got[k][0] - want[k]) < 1e-4 for k in want)


def test_descent_from_far_and_from_a_table(spark):
    df = spark.createDataFrame([("a", 6.0, 2.0), ("a", 9.0, 3.0), ("b", 1.0, 1.0)], "k string, top double, bottom double")
    far = {r.k: r.scale for r in scale.descended(df, ["k"], F.col("top"), F.col("bottom"), F.lit(-40.0), sigma=1.0).collect()}
    assert abs(far["a"] - 3) < 1e-6 and abs(far["b"] - 1) < 1e-6
    start = spark.createDataFrame([("a", 2.9)], "k string, scale double")
    got = scale.descended(df, ["k"], F.col("top"), F.col("bottom"), start, mask=F.col("top") > 8)
    assert [(r.k, round(r.scale, 6), r.n) for r in got.collect()] == [("a", 3.0, 1)]
    assert scale.descended(df.limit(0), ["k"], F.col("top"), F.col("bottom"), F.lit(1.0)).count() == 0


@pytest.mark.parametrize("few", [3, 4096])
def test_trimmed_ratio_agrees_with_windows(spark, few):
    df = pairs(spark).where("k is not null")
    want = {r.k: r.scale for r in alignment.trimmed_median_ratio(df, ["k"], F.col("top"), F.col("bottom"), 0.0, 6.0).collect()}
    got = {r.k: r.scale for r in scale.trimmed_ratio(df, ["k"], F.col("top"), F.col("bottom"), 0.0, 6.0, few=few).collect()}
    assert {k: v for k, v in want.items() if v is not None} == got
