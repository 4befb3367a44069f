"""Rigid transforms: struct(r: matrix, t: vector)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import rotation as R


def rigid(r: Column, t: Column) -> Column:
    return F.struct(r.alias("r"), t.alias("t"))


def inverse(p: Column) -> Column:
    def made(p: Column) -> Column:
        back = R.transpose(p["r"])
        return rigid(back, R.bind(R.mat_vec(back, p["t"]), lambda v: F.transform(v, lambda x: -x)))

    return R.bind(p, made)


def compose(a: Column, b: Column) -> Column:
    """First b, then a."""
    return R.bind(F.struct(a.alias("a"), b.alias("b")), lambda x: rigid(R.mat_mul(x["a"]["r"], x["b"]["r"]), R.plus(R.mat_vec(x["a"]["r"], x["b"]["t"]), x["a"]["t"])))


def act(p: Column, v: Column) -> Column:
    return R.bind(p, lambda p: R.plus(R.mat_vec(p["r"], v), p["t"]))


def from_trajectory(row: Column, scale: Column) -> Column:
    """A pose stored as tx ty tz qx qy qz qw, its translation scaled."""
    return rigid(R.matrix_from_quat(R.vec(*(R.at(row, i) for i in (6, 3, 4, 5)))), R.vec(*(R.at(row, i) * scale for i in range(3))))


def flip_axes(p: Column) -> Column:
    """y and z of the axes turned round."""
    sign = F.array(F.lit(1.0), F.lit(-1.0), F.lit(-1.0))
    return R.bind(p, lambda p: rigid(F.zip_with(p["r"], sign, lambda row, s: F.transform(row, lambda x: x * s)), F.zip_with(p["t"], sign, lambda x, s: x * s)))


# How the camera is turned in its image, against the device.
QUARTER = ((0.0, 1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.0, 1.0))


def camera_in_world(head: Column, camera: Column) -> Column:
    """From the head's pose in the world and the camera's in the head, both 4 x 4 rows: the upright camera's pose in the world."""
    of = lambda m: rigid(F.array(*(F.slice(F.get(m, F.lit(i)), 1, 3) for i in range(3))), F.array(*(R.at(m, i, 3) for i in range(3))))
    turn = F.array(*(F.array(*map(F.lit, row)) for row in QUARTER))
    return R.bind(compose(of(head), of(camera)), lambda p: rigid(R.mat_mul(p["r"], turn), p["t"]))


def look_at(eye: Column, target: Column, up: Column) -> Column:
    """The rotation whose rows are right, up and backward."""
    z = R.unit(R.minus(eye, target))
    return R.bind(F.struct(z.alias("z"), R.unit(R.cross(up, z)).alias("x")), lambda p: R.vec(p["x"], R.cross(p["z"], p["x"]), p["z"]))


def weak_to_full(s: Column, tx: Column, ty: Column, box: Column, focal: Column) -> Column:
    """A camera of scale and shift as a translation."""
    return F.array(tx, ty, F.try_divide(2 * focal, box * s))
