"""Cameras with a pose and lens distortion, and crops that are turned, with their inverses.

Points are arrays of doubles. Distortion is (k1, k2, p1, p2, k3): three radial and two tangential terms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import rotation as R

ROUNDS = 25


def _lens(p: Column, k: Column) -> tuple[Column, Column, Column]:
    """The radial factor and the tangential shifts at a point (x, y)."""
    x, y = R.at(p, 0), R.at(p, 1)
    k1, k2, p1, p2, k3 = (R.at(k, i) for i in range(5))
    r = x * x + y * y
    return 1 + k1 * r + k2 * r * r + k3 * r * r * r, 2 * p1 * x * y + p2 * (r + 2 * x * x), 2 * p2 * x * y + p1 * (r + 2 * y * y)


def distorted(p: Column, k: Column) -> Column:
    """Where the lens puts the slopes (x / z, y / z)."""

    def made(p: Column) -> Column:
        radial, dx, dy = _lens(p, k)
        return F.array(radial * R.at(p, 0) + dx, radial * R.at(p, 1) + dy)

    return R.bind(p, made)


def undistorted(p: Column, k: Column, rounds: int = ROUNDS) -> Column:
    """The slopes that the lens puts at p, by going back and forth; it ends there for lenses that fold nothing over."""

    def step(held: Column, _) -> Column:
        radial, dx, dy = _lens(held["p"], k)
        return F.struct(held["to"].alias("to"), F.array(F.try_divide(R.at(held["to"], 0) - dx, radial), F.try_divide(R.at(held["to"], 1) - dy, radial)).alias("p"))

    return R.bind(p, lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(p.alias("to"), p.alias("p")), step, lambda held: held["p"]))


def posed(p: Column, r: Column, t: Column) -> Column:
    return R.plus(R.mat_vec(r, p), t)


def project(p: Column, focal: Column, centre: Column, r: Column | None = None, t: Column | None = None, k: Column | None = None) -> Column:
    """The pixel of a point, in the world if the camera's pose is given; null in the camera's plane."""
    p = p if r is None else R.mat_vec(r, p)
    p = p if t is None else R.plus(p, t)
    slopes = R.bind(p, lambda p: F.array(F.try_divide(R.at(p, 0), R.at(p, 2)), F.try_divide(R.at(p, 1), R.at(p, 2))))
    slopes = slopes if k is None else distorted(slopes, k)
    return R.bind(slopes, lambda s: F.when(R.at(s, 0).isNotNull(), F.array(focal * R.at(s, 0) + R.at(centre, 0), focal * R.at(s, 1) + R.at(centre, 1))))


def unproject(pixel: Column, depth: Column, focal: Column, centre: Column, r: Column | None = None, t: Column | None = None, k: Column | None = None, rounds: int = ROUNDS) -> Column:
    """The point at a depth (z in the camera) that project() puts at a pixel."""
    slopes = F.array((R.at(pixel, 0) - R.at(centre, 0)) / focal, (R.at(pixel, 1) - R.at(centre, 1)) / focal)
    slopes = slopes if k is None else undistorted(slopes, k, rounds)
    p = R.bind(slopes, lambda s: F.array(R.at(s, 0) * depth, R.at(s, 1) * depth, depth))
    p = p if t is None else R.minus(p, t)
    return p if r is None else R.mat_vec(R.transpose(r), p)


def crop(cx: Column, cy: Column, scale: Column, width: float, height: float, degrees: Column | None = None) -> Column:
    """The transform of an image's points to a crop around a centre, turned about the crop's middle: struct(a: two rows, b: shift)."""
    side = 200 * scale + 1e-6
    sx, sy = width / side, height / side
    bx, by = width * (0.5 - cx / side), height * (0.5 - cy / side)
    if degrees is None:
        return F.struct(F.array(F.array(sx, F.lit(0.0)), F.array(F.lit(0.0), sy)).alias("a"), F.array(bx, by).alias("b"))
    # against the turn of the image
    c, s = F.cos(-F.radians(degrees)), F.sin(-F.radians(degrees))
    mx, my = width / 2, height / 2
    return F.struct(F.array(F.array(c * sx, -s * sy), F.array(s * sx, c * sy)).alias("a"), F.array(c * (bx - mx) - s * (by - my) + mx, s * (bx - mx) + c * (by - my) + my).alias("b"))


def inverse_crop(t: Column) -> Column:
    def made(t: Column) -> Column:
        (a, b), (c, d) = [[R.at(t["a"], i, j) for j in range(2)] for i in range(2)]
        det = a * d - b * c  # the product of the two scales
        x, y = R.at(t["b"], 0), R.at(t["b"], 1)
        return F.struct(F.array(F.array(d / det, -b / det), F.array(-c / det, a / det)).alias("a"), F.array((b * y - d * x) / det, (c * x - a * y) / det).alias("b"))

    return R.bind(t, made)


def cropped(p: Column, t: Column) -> Column:
    """A point, counted from 0, in a crop."""
    return R.bind(F.struct(p.alias("p"), t.alias("t")), lambda x: F.array(*(R.at(x["t"]["a"], i, 0) * R.at(x["p"], 0) + R.at(x["t"]["a"], i, 1) * R.at(x["p"], 1) + R.at(x["t"]["b"], i) for i in range(2))))


def cropped_pixel(p: Column, t: Column) -> Column:
    """A pixel, counted from 1, in a crop: whole pixels, the rest cut off, counted from 1 again."""
    return R.bind(cropped(F.array(R.at(p, 0) - 1, R.at(p, 1) - 1), t), lambda q: F.array(R.at(q, 0).cast("int") + 1, R.at(q, 1).cast("int") + 1))
