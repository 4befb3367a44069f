from __future__ import annotations

import numpy as np
import pytest

from plumbline import catalog
from plumbline.operators import tracks


def vectors(spark, sf_dir, n):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    return {r.vec_id: np.array(r.embedding[:n], float) for r in rows}, {r.vec_id: r.label for r in rows}


def test_nearest_rotation_against_numpy(spark, sf_dir):
    x, _ = vectors(spark, sf_dir, 9)
    got = catalog.QUERIES["nearest_rotation"](spark, sf_dir).collect()
    assert len(got) == len(x)
    for r in got:
        m = np.array(r[1:]).reshape(3, 3)
        u, s, v = np.linalg.svd(x[r.vec_id].reshape(3, 3))
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-4) and np.linalg.det(m) > 0
        assert np.allclose(m, u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v, atol=1e-5)


def test_mean_rotation_against_numpy(spark, sf_dir):
    x, label = vectors(spark, sf_dir, 4)
    for r in catalog.QUERIES["mean_rotation"](spark, sf_dir).collect():
        total = np.zeros((3, 3))
        for i, q in x.items():
            if label[i] == r.label:
                w, a = q[0] / np.linalg.norm(q), q[1:] / np.linalg.norm(q)
                k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
                total += np.eye(3) + 2 * w * k + 2 * k @ k
        u, _, v = np.linalg.svd(total)
        assert np.allclose(np.array(r[1:]).reshape(3, 3), u @ v, atol=1e-4)


@pytest.mark.parametrize("seed", range(3))
def test_widened_band_is_the_loop_with_a_cap(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("s", int(k), float(v)) for k in range(12) for v in rng.uniform(-3, 3, 2)]
    near, far, want = 0.0, 0.5, {}
    for k in range(12):
        steps = 0
        while not any(near - 1e-9 <= v <= far + 1e-9 for _, i, v in rows if i == k) and steps < 100:
            near, far, steps = near - 0.1, far + 0.1, steps + 1
        want[k] = (near, far)
    got = tracks.widened(spark.createDataFrame(rows, "seq string, k int, v double"), ["seq"], "k", tracks.F.col("v"), 0.0, 0.5).collect()
    assert all(np.allclose((r.near, r.far), want[r.k], atol=1e-6) for r in got) and len(got) == 12


def test_two_hands_there_and_back(spark):
    rows = [(0, False, [1.0, 2.0]), (0, True, [3.0, 4.0]), (1, True, [5.0, 6.0])]
    packed = tracks.side_by_side(spark.createDataFrame(rows, "frame int, r boolean, x array<double>"), ["frame"], tracks.F.col("r"), "x", 2)
    assert sorted(map(tuple, packed.collect())) == [(0, [1, 2, 3, 4]), (1, [0, 0, 5, 6])]
    assert sorted(map(tuple, tracks.one_by_one(packed, "x", 2).collect())) == sorted([*rows, (1, False, [0.0, 0.0])])


def test_known_translation_is_found(spark):
    rng = np.random.default_rng(1)
    t, points = np.array([0.3, -0.2, 4.0]), rng.normal(size=(20, 3))
    rows = [(1, p.tolist(), ((p + t)[:2] / (p + t)[2]).tolist(), float(w)) for p, w in zip(points, rng.random(20), strict=True)]
    df = spark.createDataFrame(rows, "k int, p array<double>, ray array<double>, w double")
    assert np.allclose(tracks.camera_translation(df, ["k"], tracks.F.col("p"), tracks.F.col("ray"), tracks.F.col("w")).first()[1:], t)
