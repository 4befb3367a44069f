"""Windows of hands and skeletons on rows with gaps, ties and missing hands."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import infill
from plumbline.operators.skeleton import Skeleton

SCHEMA = "w long, right boolean, frame long, trans array<double>, rot array<double>, pose array<double>, betas array<double>, valid boolean, off array<double>"


def matrix(v):
    a = np.linalg.norm(v)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / (a or 1)
    return np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * k @ k


def rows(valid, offset):
    rng = np.random.default_rng(4)
    return [(0, True, t, rng.normal(size=3).tolist(), rng.uniform(-1, 1, 3).tolist(), rng.uniform(-1, 1, 45).tolist(), rng.normal(size=10).tolist(), v, offset) for t, v in enumerate(valid)]


def test_there_and_back_with_an_offset(spark):
    data = rows([True] * 4, [0.5, -2.0, 1.0])
    df = spark.createDataFrame(data, SCHEMA)
    there = infill.canonicalise(df, ["w", "right"], "frame", F.col("off"))
    first = there.where("frame = 0").first()
    assert np.allclose(first.rot, 0, atol=1e-9) and np.allclose(first.trans, 0, atol=1e-9)
    second = there.where("frame = 1").first()
    want = matrix(np.array(data[0][4])).T @ (np.array(data[1][3]) - np.array(data[0][3]))
    assert np.allclose(second.trans, want)
    for a, b in zip(sorted(infill.to_world(there, F.col("off")).collect(), key=lambda r: r.frame), data, strict=True):
        assert np.allclose(a.trans, b[3]) and np.allclose(matrix(np.array(a.rot)), matrix(np.array(b[4])))


@pytest.mark.parametrize(("valid", "sources"), [([False, True, False, False, True, False], [1, 1, None, None, 4, 4]), ([False, True, False], [0, 1, 2]), ([False, False], [0, 1]), ([None, True, True], [1, 1, 2])])
def test_gaps(spark, valid, sources):
    data = rows(valid, None)
    got = sorted(infill.fill_hands(spark.createDataFrame(data, SCHEMA), ["w", "right"], "frame").collect(), key=lambda r: r.frame)
    for r, at in zip(got, sources, strict=True):
        if at is not None:
            assert r.trans == data[at][3] and r.pose == data[at][5]
        else:
            share = (r.frame - 1) / 3
            a, b = matrix(np.array(data[1][5][6:9])), matrix(np.array(data[4][5][6:9]))
            turn = a.T @ b
            angle = math.acos((np.trace(turn) - 1) / 2)
            axis = np.array([turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1]]) / (2 * math.sin(angle))
            assert np.allclose(matrix(np.array(r.pose[6:9])), a @ matrix(axis * angle * share))
            assert np.allclose(r.betas, np.array(data[1][6]) + share * (np.array(data[4][6]) - np.array(data[1][6])))


def test_missing_and_repeated_hands(spark):
    data = rows([True] * 2, None)
    df = infill.canonicalise(spark.createDataFrame([*data, data[0]], SCHEMA), ["w", "right"], "frame")
    packed = infill.pack(df, ["w", "frame"], F.col("right"))
    assert all(len(r.packed) == 218 and set(r.packed[:109]) == {0.0} for r in packed.collect())
    back = infill.unpack(packed).collect()
    assert len(back) == 2 and all(r.is_right for r in back)
    assert infill.unpack(infill.pack(df.limit(0), ["w", "frame"], F.col("right"))).count() == 0


def test_skeleton_from_a_table(spark):
    tree = spark.createDataFrame([(1, 0, [0.0, 3.0, 4.0]), (0, -1, [9.0, 9.0, 9.0]), (2, 1, [1.0, 0.0, 0.0])], "joint int, parent int, offset array<double>")
    own = Skeleton.from_table(tree)
    assert own.parents == (-1, 0, 1) and own.lengths == [1.0, 5.0, 1.0] and own.leaves == [False, False, True]
    with pytest.raises(ValueError, match="without gaps"):
        Skeleton.from_table(tree.where("joint <> 1"))
    with pytest.raises(ValueError, match="without a parent"):
        Skeleton((-1, 2, 1), ((0, 0, 0),) * 3)
    assert own.without({1})[0].parents == (-1, 0)
    half = math.sqrt(0.5)
    df = spark.createDataFrame([([[half, half, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [half, 0.0, 0.0, half]], [1.0, 1.0, 1.0])], "q array<array<double>>, root array<double>")
    turned = df.select(F.inline(own.forward(F.col("q"), F.col("root")))).collect()
    assert np.allclose([r.place for r in turned], [[1, 1, 1], [1, -3, 4], [2, -3, 4]])
    assert df.select(own.forward(F.col("q"), F.col("root"), identity_leaves=True)[2]["turn"]).first()[0] == [1.0, 0.0, 0.0, 0.0]


def test_units_and_positions_are_inverse(spark):
    own = Skeleton((-1, 0, 0, 2), ((0, 0, 0), (0, 2, 0), (1, 1, 1), (0.5, 0, 0)))
    df = spark.createDataFrame([([[1.0, 2.0, 3.0], [0.0, 1.0, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, -1.0]],)], "u array<array<double>>")
    back = df.select(own.units(own.positions(F.col("u")))).first()[0]
    assert np.allclose(back, df.first().u)
