"""Lenses and crops against numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import cameras


def row(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} array<double>" if isinstance(v, list) and not isinstance(v[0], list) else f"{n} array<array<double>>" if isinstance(v, list) else f"{n} double" for n, v in columns.items()))


def test_lens_there_and_back(spark):
    k = [-0.2, 0.05, 0.01, -0.02, 0.004]
    for x, y in ((0.0, 0.0), (0.4, -0.3), (-0.6, 0.5)):
        r = x * x + y * y
        radial = 1 + k[0] * r + k[1] * r * r + k[4] * r**3
        want = [radial * x + 2 * k[2] * x * y + k[3] * (r + 2 * x * x), radial * y + 2 * k[3] * x * y + k[2] * (r + 2 * y * y)]
        df = row(spark, p=[x, y], k=k)
        there = cameras.distorted(F.col("p"), F.col("k"))
        got, back = df.select(there, cameras.undistorted(there, F.col("k"))).first()
        assert np.allclose(got, want) and np.allclose(back, [x, y], atol=1e-9)


def test_plain_cameras(spark):
    centre, focal = F.array(F.lit(5.0), F.lit(6.0)), F.lit(100.0)
    df = row(spark, p=[1.0, 2.0, 4.0], behind=[1.0, 1.0, 0.0])
    assert df.select(cameras.project(F.col("p"), focal, centre), cameras.project(F.col("behind"), focal, centre)).first() == ([30.0, 56.0], None)
    assert df.select(cameras.unproject(cameras.project(F.col("p"), focal, centre), F.lit(4.0), focal, centre)).first()[0] == [1.0, 2.0, 4.0]


def test_turned_crop(spark):
    cx, cy, scale, w, h, turn = 40.0, 70.0, 0.6, 256.0, 128.0, 25.0
    side = 200 * scale + 1e-6
    t = np.array([[w / side, 0, w * (-cx / side + 0.5)], [0, h / side, h * (-cy / side + 0.5)], [0, 0, 1]])
    a = math.radians(-turn)
    move, rot = np.eye(3), np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    move[:2, 2] = -w / 2, -h / 2
    turned = np.linalg.inv(move) @ rot @ move @ t
    df = row(spark, p=[33.0, 91.0])
    for matrix, degrees in ((t, None), (turned, F.lit(turn))):
        made = cameras.crop(F.lit(cx), F.lit(cy), F.lit(scale), w, h, degrees)
        point, pixel, back = df.select(cameras.cropped(F.col("p"), made), cameras.cropped_pixel(F.col("p"), made), cameras.cropped(F.col("p"), cameras.inverse_crop(made))).first()
        assert np.allclose(point, (matrix @ [33, 91, 1])[:2])
        assert pixel == ((matrix @ [32, 90, 1])[:2].astype(int) + 1).tolist()
        assert np.allclose(back, (np.linalg.inv(matrix) @ [33, 91, 1])[:2])
